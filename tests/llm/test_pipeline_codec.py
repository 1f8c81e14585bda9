"""The last stage of the pipeline encodes and decodes."""

import hashlib
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_last_stage_decodes_what_it_encoded(spark):
    texts = ["plain words, twice twice", "  naïve café\n\n\tπ ≈ 3.14159", "日本語 🙂🙂", "", None,
             "x" * 300, "a <|endoftext|> b"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in corpus_pipeline.encode_tokens(spark, docs, "").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert bytes(rows[i].ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()

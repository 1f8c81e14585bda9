"""The training-data operators against brute force, and their defined edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from edgeline.llm import bpe, html_text, language, lm, mixing, quality, separators, simhash, spots, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0D]+")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
rnd = random.Random(4)


def prose(n, seed):
    r = random.Random(seed)
    pool = ("the of and house river stone walks under bright evening light with many people who "
            "said that it was not far from here").split()
    return " ".join(r.choice(pool) + r.choice(["", "", ",", "."]) for _ in range(n))


EDGE = ["", None, " \t\n", "one", "one two", "ÄÖ ß x", "same text here", "same text here",
        "12 34 ...", "<|endoftext|> a\x1fb c", "a b c d e f g h i " * 3, "x" * 5000,
        "line one\nline one\n\nline two\nline one", "don't #*$%&|<> stop"]
TEXTS = EDGE + [prose(rnd.randint(1, 120), i) for i in range(40)] + [prose(60, 3)] * 4
NEAR = [prose(200, 900), prose(200, 900).replace("river", "stream", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "ä"][i % 4], 1)
            for i, t in enumerate(TEXTS + NEAR)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with further columns and a repeated, an id-less and a NULL row."""
    extra = docs.withColumns({"size": F.lit("x"), "score": F.lit(1), "fp": F.lit(2),
                              "h": F.lit(3), "kept": F.lit("no"), "n": F.lit(0)})
    none = extra.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in extra.dtypes])
    return extra.unionByName(extra.filter("doc_id = 20")).unionByName(none)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(text):
    return WORDS.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- 1 near duplicates -------------------------------------------------------
def slow_fingerprint(text, k=3):
    w = words(lowered(text))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(items, near):
    """Smallest id reachable, for (id, value) items."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (i, a), (j, b) in itertools.combinations(items, 2):
        if near(a, b):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_simhash_matches_brute_force(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    want = {i: slow_fingerprint(t) for i, t in enumerate(TEXTS + NEAR)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    classes = slow_classes(list(want.items()), lambda a, b: (a ^ b).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == classes


@pytest.mark.parametrize("radius,tile", [(2, 16), (2, 8192), (9, 16)])
def test_links_of_random_fingerprints(spark, radius, tile):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(40)]
    codes = list(dict.fromkeys(base + [b ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)
                                       for b in base for _ in range(3)]))
    rows = [(i, c.to_bytes(8, "little")) for i, c in enumerate(codes)]
    got = simhash.links(spark.createDataFrame(rows, "node long, fp binary"), radius, tile).collect()
    near = lambda a, b: (a ^ b).bit_count() <= radius
    linked = {(x.a, x.b) for x in got}
    items = list(range(len(codes)))
    by_links = slow_classes([(i, i) for i in items],
                            lambda i, j: (i, j) in linked or (j, i) in linked)
    assert by_links == slow_classes(list(enumerate(codes)), near)


def test_simhash_clashes_and_empty(clashing, docs):
    got = simhash.near_duplicates(clashing).collect()
    assert len(got) == clashing.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and len(TEXTS) in ids and len(TEXTS) + 1 not in ids
    assert [i for i in ids if i in (6, 7)] == [6]


def test_keep_one_equals_the_bit_distance(spark):
    """Texts that differ in a few of many words, so that distances spread around the radius."""
    r = random.Random(11)
    texts = []
    for n in [12, 60, 400, 900] * 6:
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        texts += [base, [*base[:-1], "other"], ["other", *base[1:]], base + base[:2], base]
    texts = [" ".join(t) for t in texts]
    codes = [int.from_bytes(simhash.fingerprint(t), "little") for t in texts]
    same = slow_classes(list(enumerate(codes)), lambda a, b: (a ^ b).bit_count() <= 2)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert got == set(same.values()) and 24 < len(got) < 96


def test_a_dense_group_gives_linear_links(spark):
    """Two thousand fingerprints around one: links span the group, no pairs come out."""
    base = random.Random(1).getrandbits(64)
    codes = {base} | {base ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    rows = [(i, c.to_bytes(8, "little")) for i, c in enumerate(sorted(codes))]
    nodes = spark.createDataFrame(rows, "node long, fp binary")
    got = simhash.links(nodes, 2).collect()
    assert len(got) < 200 * len(rows)
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in got:
        label[root(x.a)] = root(x.b)
    assert len({root(i) for i, _ in rows}) == 1


def test_keep_one_without_unique_ids(spark):
    a, b, c, d, e = (prose(60, 500 + i) for i in range(5))
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "de", "s", 1),
            (None, c, "en", "s", 1), (7, c, "en", "s", 1), (8, d, "en", "s", 1),
            (8, e, "en", "s", 1), (8, e, "en", "s", 1), (9, e, "en", "s", 1)]
    got = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    pairs = [(r.doc_id, r.text) for r in got]
    assert len(pairs) == 5 and set(pairs) == {(None, a), (None, b), (7, c), (8, d), (8, e)}
    again = simhash.keep_one(spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert set(map(tuple, again)) == set(map(tuple, got))


# ---- 2 language --------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    syllables = {"en": "the ing and tion ly ea".split(), "de": "sch und keit ung ei ü".split()}
    rows = []
    for i in range(200):
        lang = ["en", "de"][i % 2]
        r = random.Random(i)
        text = " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(30))
        rows.append((i, text, lang, "s", 1))
    docs = spark.createDataFrame(rows + [(200, None, "en", "s", 1), (201, "12 ..", "de", "s", 1),
                                         (None, None, None, None, None)], DOCS)
    model = language.fit(docs, ~language.held_out(docs))
    out = language.predict(docs, model).collect()
    assert all(r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 200)
    assert {r.lang_pred for r in out if r.doc_id is None or r.doc_id >= 200} == {"und"}
    assert all(0 <= r.score <= 1 for r in out)


def test_language_kernel_is_presence():
    a, b = language.presence("abc abc"), language.presence("ABC")
    assert language.presence("...1") is None and language.presence(None) is None
    both = (a & b).sum() / math.sqrt(a.sum() * b.sum())
    assert np.isclose(language._kernel(a[None], b[None])[0, 0], both)


def test_language_without_training_rows(docs):
    model = language.fit(docs, F.lit(False))
    out = language.predict(docs, model).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in out] == ["und"]


def test_language_letters_and_sample(spark):
    assert language.presence("½ ² Ⅷ ①") is None and language.presence("12 é") is not None
    rows = [(None if i % 4 else i, None if i % 2 else f"{'der und' if i % 8 else 'the of'} {i}",
             "de" if i % 8 else "en") for i in range(400)]
    rows += [(7, "the of and", "en")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True), per_language=40)
    assert model.languages == ["de", "en"]
    # A text with letters has a language, even where no value is positive.
    model.weights = -np.abs(model.weights)
    got = {(r.lang_pred, r.score) for r in language.predict(df.filter("text is not null"), model)
           .select("lang_pred", "score").collect()}
    assert all(lang in ("de", "en") and score == 0 for lang, score in got)


# ---- 3 quality ---------------------------------------------------------------
def slow_base(text):
    w, text = words(text), text or ""
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(cover))


def slow_buckets(text):
    ends = [w[-3:] for w in words(text)]
    out = []
    for i, e in enumerate(ends):
        h = xxhash.xxh64_intdigest(e, 42)
        if i:
            h = xxhash.xxh64_intdigest(ends[i - 1], h)
        out.append((h - (1 << 64) if h >> 63 else h) % quality.BUCKETS)
    return out


def test_quality_matches_brute_force(docs, labels):
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in enumerate(TEXTS + NEAR):
        raw.update(slow_buckets(t))
        if i in good:
            target.update(slow_buckets(t))
    n, m, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    for i, t in enumerate(TEXTS + NEAR):
        r = got[i]
        base = slow_base(t)
        assert base == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        if m:
            each = [math.log((target[g] + 1) / (m + b) / ((raw[g] + 1) / (n + b)))
                    for g in slow_buckets(t)]
            mean = sum(each) / len(each) if each else 0.0
            assert math.isclose(r.log_ratio, mean, abs_tol=1e-9)
            assert r.kept == (not r.base_failed and mean >= quality.THRESHOLD)


def test_quality_edge_tables(clashing, docs, labels):
    assert quality.judge(clashing, labels).count() == clashing.count()
    alone = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.log_ratio == 0 and r.kept == (not r.base_failed) for r in alone)
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_sees_whole_words(spark):
    r = random.Random(8)
    text = lambda stems: " ".join(r.choice(stems) + "ing" for _ in range(40))
    good, spam = ["walk", "sing", "paint"], ["gambl", "bett", "loan"]
    rows = [(i, text(spam if i % 4 == 3 else good), "en", "s", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 3), 0) for i in range(80)],
                                   "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels, features=(quality.WHOLE, quality.ENDS)).collect()
    spam = [r.log_ratio for r in out if r.doc_id % 4 == 3]
    assert max(spam) < quality.THRESHOLD
    assert max(spam) < min(r.log_ratio for r in out if r.doc_id % 4 != 3)


# ---- 4 toxicity --------------------------------------------------------------
def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 1.0, "kill": 1.0}, {"mor": 0.0, "moro": 1.0})
    plain, aimed = g.evidence("an idiot here."), g.evidence("you idiot.")
    assert aimed > plain > g.evidence("not an idiot.") > 0
    assert plain > g.evidence("he said idiot.") / 1.25 > 0
    assert g.evidence("kill the lights.") == 0 < g.evidence("they will kill you. ") + \
        g.evidence("you will kill.")
    assert g.evidence("morons") == 1.0 and g.evidence(None) == g.evidence("") == 0.0


def test_grammar_modifiers_on_either_side():
    g = toxicity.Grammar({"idiot": 1.0, "kill": 1.0}, {})
    assert g.evidence("you idiot, he said.") == g.evidence("he said, you idiot.") < g.evidence("you idiot.")
    assert g.evidence("an idiot he is not.") < g.evidence("an idiot he is.")
    assert g.evidence('"idiot" they wrote.') == g.evidence("they wrote idiot.")
    assert g.evidence("he said idiot. " * 20) == g.evidence("he said idiot.")
    assert g.evidence("you idiot. " * 2) == 2 * g.evidence("you idiot.")
    assert g.evidence("kill you.") == g.evidence("you kill.") > 0 == g.evidence("kill idly.")


def test_terms_are_the_tokens_of_scoring(spark):
    text = "don't l’été stop,here x2y"
    row = spark.createDataFrame([(text,)], "t string").select(toxicity._terms(F.col("t"))).first()
    terms = {t for t in row[0] if not t.startswith("^")}
    assert terms == {t for t in toxicity._TOKEN.findall(text) if len(t) > 1}


def test_toxicity_held_out(spark):
    rows, marks = [], []
    for i in range(300):
        toxic = int(i % 3 == 0)
        bad = " ".join(f"grumb{s}" for s in random.Random(i).sample(["le", "ly", "er", "ing"], 2))
        rows.append((i, prose(30, i) + (" " + bad if toxic else ""), "en", "s", 1))
        marks.append((i, 1, toxic))
    docs = spark.createDataFrame(rows + [(999, None, None, None, None)], DOCS)
    labels = spark.createDataFrame(marks + [(None, None, 1), (4000, 1, None)],
                                   "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(docs, labels, ~toxicity.held_out(docs))
    out = toxicity.score(docs, grammar).withColumn("held", toxicity.held_out(docs)).collect()
    assert any(r.held for r in out)
    assert all((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in out if r.doc_id < 300)
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity_without_labels(clashing, labels):
    grammar = toxicity.learn(clashing, labels.limit(0), F.lit(True))
    out = toxicity.score(clashing, grammar)
    assert out.count() == clashing.count() and out.filter("score >= 0.7").count() == 0


# ---- 5 BPE -------------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    return bpe.Automaton(VOCAB, public_tokenizers.PATTERN).ready()


def test_bpe_equals_the_library(codec):
    library = Tokenizer.from_file(VOCAB)
    r = random.Random(2)
    signs = "aaabbcthe  in'sre\n\t1#éß日<|endoftext|>\x1f\x85  "
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(signs) for _ in range(r.randint(0, 50)))
                                        for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == text == library.decode(want, skip_special_tokens=False)


def test_bpe_gadget_of_a_doubled_label(codec):
    a = bpe.Automaton.__new__(bpe.Automaton)
    a.label, a.special, a.pattern = {0: b"a", 1: b"aa", 2: b"b", 3: b"aab"}, {}, ".+"
    a._compile([(0, 0, 1), (1, 2, 3)])
    a.ready()
    for text in map("".join, itertools.product("ab", repeat=6)):
        want, parts = [], list(text)
        for left, right in (("a", "a"), ("aa", "b")):
            i, done = 0, []
            while i < len(parts):
                if parts[i:i + 2] == [left, right]:
                    done.append(left + right)
                    i += 2
                else:
                    done.append(parts[i])
                    i += 1
            parts = done
        want = [{"a": 0, "aa": 1, "b": 2, "aab": 3}[p] for p in parts]
        assert np.frombuffer(a.piece(text), "<u4").tolist() == want
        assert a.pieces([text, "", text]) == [a.piece(text), b"", a.piece(text)]


def test_bpe_pieces_side_by_side(codec, monkeypatch):
    """Random letters step back often; lengths on both sides of the limit, few arcs kept."""
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    monkeypatch.setattr(bpe, "ABREAST", 300)
    monkeypatch.setattr(bpe, "CHARS", 5000)
    r = random.Random(9)
    made = ["".join(r.choice("entiohmaßé1 ") for _ in range(r.choice((0, 1, 7, 20, 62, 63, 64, 65, 90))))
            for _ in range(900)]
    assert codec.pieces(made) == [codec.piece(p) for p in made]
    assert codec.pieces([]) == [] and list(codec.encode_all([])) == []
    library = Tokenizer.from_file(VOCAB)
    texts = [*made, None, "a<|endoftext|>b", "x" * 20_000]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(
            text or "", add_special_tokens=False).ids


def test_table_of_keys():
    r = np.random.default_rng(3)
    keys = r.choice(1 << 40, 700, replace=False)
    table = bpe._Table(10)
    table.add(keys[:400], np.arange(400))
    table.add(keys[400:600], np.arange(400, 600))
    assert table.get(keys).tolist() == [*range(600), *[-1] * 100]


def test_bpe_rows(clashing, docs):
    out = bpe.encode(clashing, VOCAB, public_tokenizers.PATTERN)
    assert set(out.columns) == {*clashing.columns, "ids", "decoded"}
    assert all(r.decoded == (r.text or "") for r in out.collect())
    row = bpe.digest(docs.filter("text is null"), VOCAB, public_tokenizers.PATTERN).first()
    assert row.n_tokens == 0 and row.ids_sha256 == hashlib.sha256(b"").hexdigest()


# ---- 6 pages -----------------------------------------------------------------
def page(i, body, menu="<ul><li><a href='/a'>Home</a></li></ul>"):
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body>"
            f"<div>{menu}</div><div class='box'>Call us now</div><!-- x{i} -->"
            f"<article><h1>Head {i}</h1>{body}</article>"
            f"<div id='comments'><p>first! {i}</p></div><footer>&copy; me</footer></body></html>")


def test_page_text(spark):
    bodies = ["<p>One &amp; <b>two</b>\n three<p>four<br>five", "<p>Same</p>", "<p>Same</p>",
              "<p>a<script>x('</p>')</script>b</p><aside>ad</aside>", "<p>Same</p>", "<ul><li>x<li>y</ul>"]
    rows = [(i, f"http://h.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    rows += [(10, "http://h.example/n", None), (11, None, ""), (None, None, "<p>free<p>text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[0] == "Head 0 One & two three four five"
    assert got[1] == "Head 1 Same" and got[3] == "Head 3 ab" and got[5] == "Head 5 x y"
    assert got[10] == got[11] == "" and got[None] == "free text"


def test_template_without_an_article(spark):
    shared = "<div><p>Welcome to our site</p></div>"
    rows = [(i, "http://h.example/x", f"<body>{shared}<div><p>story {i} long</p></div></body>")
            for i in range(6)] + [(9, "http://other.example/", f"<body>{shared}</body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[2] == "story 2 long" and got[9] == "Welcome to our site"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_template_inside_the_article(spark):
    notice = "<div><p>Sign up for our weekly letter</p></div>"
    copy = f"<h1>Copied</h1><p>{prose(40, 77)}</p><p>{prose(40, 78)}</p>"
    page = lambda body: f"<body><article>{body}</article></body>"
    story = lambda i: f"<h1>Head {i}</h1><p>{prose(30, i)}</p>"
    # The notice is on one page in fifty of a large host.
    rows = [(i, "http://h.example/x", page(story(i) + (notice if i % 50 == 0 else "") + "<p>Yes.</p>"))
            for i in range(300)]
    rows += [(1000 + i, "http://h.example/c", page(copy)) for i in range(8)]
    rows += [(2000 + i, "http://i.example/c", f"<body><p>{prose(40, 79)}</p></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[i] == f"Head {i} {prose(30, i)} Yes." for i in range(300))
    assert all(got[1000 + i] == f"Copied {prose(40, 77)} {prose(40, 78)}" for i in range(8))
    assert all(got[2000 + i] == prose(40, 79) for i in range(8))


def test_pages_of_any_nesting_and_markup():
    assert html_text.scan("<div>" * 5000 + "deep" + "</div>" * 5000)[0].split() == ["deep"]
    start = time.monotonic()
    for hostile in ("<script " * 131_072, "<a '" * 200_000, "<a x=\"" * 100_000, "<!--" * 200_000,
                    "<b>" * 50_000 + "<br>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000,
                    "<article>" * 20_000 + "one two three"):
        html_text.scan(hostile)
    assert time.monotonic() - start < 30


def test_class_words_and_comment_articles():
    text = lambda page: html_text.cut(html_text.scan(page)[0], ())
    body = ("<p class='related-work'>a</p><div class='share-price'>b</div><p class='notice-board'>c"
            "</p><div class='share-buttons'>d</div><div class='adSlot'>e</div><p data-id='ad'>f</p>")
    assert text(f"<article>{body}</article>") == "a b c f"
    assert text("<article>x</article><article class='comment'>y</article>") == "x"
    assert text("<article>x<div class='ad'>y</div>z<script>1</script>w</article>") == "x zw"
    assert text("a &lt;b&gt; &amp; x&nbsp;y<p title='a>b'>c") == "a <b> & x y c"
    assert text("kept <p class='open") == "kept"
    page = f"<h1>h</h1><article>{body}<article>x</article></article>z"
    assert html_text.scan(page, sketch=False) == (html_text.scan(page)[0], [])


def test_templates_equal_a_plain_count(spark):
    rng = random.Random(5)
    blocks = [f"<div>{prose(rng.randint(2, 6), k)}</div>" for k in range(40)]
    rows = []
    for i in range(120):
        some = rng.sample(blocks, 3)
        rows.append((i, f"http://h{i % 3 // 2}.example/", "<article>" + "".join(
            some[:2] + [f"<p>{prose(60, 1000 + i)}</p>"] + some[2:]) + "</article>", "own", i))
    pages = spark.createDataFrame(rows, "number long, url string, html string, text string, host long")
    seen = collections.Counter((u, b) for _, u, h, _, _ in rows for b in blocks if b in h)
    want = {}
    for i, u, h, _, _ in rows:
        for b in blocks:
            if b in h and len(b.split()) >= html_text.LEAST_WORDS and seen[u, b] >= html_text.MIN_PAGES:
                h = h.replace(b, "")
        want[i] = " ".join(re.sub("<[^>]*>", " ", h).split())
    out = html_text.extract(pages)
    assert set(out.columns) == {"number", "url", "host", "text"}
    got = {r.number: (r.text, r.host) for r in out.collect()}
    assert got == {i: (t, i) for i, t in want.items()}
    assert any(len(t.split()) < 64 for t in want.values())


# ---- 7 token counts ----------------------------------------------------------
@pytest.mark.parametrize("block", [3, 64, 1 << 18])
def test_separator_scan(clashing, codec, block):
    got = separators.count_tokens(clashing, VOCAB, public_tokenizers.PATTERN, block).collect()
    special, codec.special = codec.special, {}
    want = [(r.doc_id, len(codec.encode(r.text)) // 4) for r in clashing.collect()]
    codec.special = special
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order(map(tuple, got)) == order(want)


def test_separator_scan_of_raw_blocks(spark):
    ids = [[5, 6], [7], [50256, 50256, 1], [2, 50256], [9]]
    rows = [(1, i, np.array(b, "<u2").tobytes()) for i, b in enumerate(ids)]
    blocks = spark.createDataFrame(rows, "file long, block long, ids binary")
    got = sorted((r.number, r.n_tokens) for r in separators.scan(blocks).collect())
    assert got == [(0, 3), (1, 0), (2, 2)]
    assert separators.scan(blocks.limit(0)).count() == 0


# ---- 8 mixing ----------------------------------------------------------------
def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mixture(docs, clashing):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    targets = slow_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) < 25 for s, t in targets.items())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert sum(len(words(r.text)) for r in copies.collect()) == sum(taken.values())
    more = clashing.withColumns({c: F.lit(-7) for c in (
        "target", "source_size", "rounds", "extra", "taken", "n_words")})
    assert mixing.mix(more).count() == clashing.count()
    kept = mixing.mixed(more)
    assert kept.columns == more.columns
    assert kept.count() and kept.filter("target <> -7 OR taken <> -7 OR size <> 'x'").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_small_sources_are_capped(spark):
    rows = [(i, "w " * n, None, s, 1) for i, (s, n) in enumerate(
        [("a", 400), ("b", 3), ("c", 1), ("d", 50), (None, 0)])]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    want = slow_targets({"a": 400, "b": 3, "c": 1, "d": 50, None: 0})
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9) for r in got)


def test_subset_sum_is_best_possible():
    r = random.Random(5)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(1, 30), r.randint(1, 5))))
        counts = np.array([r.randint(1, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = r.randint(0, total)
        taken = mixing.fit_lengths(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert budget - int(lengths.max()) <= int((taken * lengths).sum()) <= budget


# ---- 9 language model --------------------------------------------------------
def test_language_model_counts(docs):
    got = {r.doc_id: r for r in lm.score(docs, ~lm.held_out(docs)).collect()}
    tokens = {i: words(lowered(t)) + ["\n"] for i, t in enumerate(TEXTS + NEAR)}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    c = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w),
                            rel_tol=1e-9)
        assert r.score < 0
    held = [got[i] for i in tokens if i not in train and len(tokens[i]) > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_chunks_change_nothing(docs, monkeypatch):
    plain = {r.doc_id: r for r in lm.score(docs, ~lm.held_out(docs)).collect()}
    monkeypatch.setattr(lm, "LONG_CHARS", 40)
    monkeypatch.setattr(lm, "CHUNK_CHARS", 500)
    monkeypatch.setattr(lm, "CHUNK_IDS", 7)
    for r in lm.score(docs, ~lm.held_out(docs)).collect():
        assert math.isclose(r.score, plain[r.doc_id].score, rel_tol=1e-9)
        assert math.isclose(r.base_score, plain[r.doc_id].base_score, rel_tol=1e-9)


def test_sorted_keys_unpack():
    r = np.random.default_rng(1)
    for n, top in ((1, 64), (2, 64), (500, 64), (500, 20), (3, 1)):
        keys = np.unique(r.integers(0, 2 ** top, n, dtype=np.uint64, endpoint=False)
                         if top < 64 else r.integers(0, 2 ** 64 - 1, n, dtype=np.uint64))
        assert lm._unpack_sorted(lm._pack_sorted(keys)).tolist() == keys.tolist()
        parts = lm.part_of(keys, 7)
        assert (np.diff(parts.astype(int)) >= 0).all() and (parts < 7).all()


def test_language_model_is_a_distribution(spark):
    rows = [(i, t, None, None, 1) for i, t in enumerate(["a b", "a a", "b", ""] * 5)]
    docs = spark.createDataFrame(rows, DOCS)
    probe = spark.createDataFrame([(1000 + i, t, None, None, 1) for i, t in enumerate(
        ["a", "b", "a a", "a b", "b a", "b b", "", "zz"])], DOCS)
    out = lm.score(docs.unionByName(probe), F.col("doc_id") < 1000)
    got = {r.doc_id - 1000: 10 ** r.score for r in out.filter("doc_id >= 1000").collect()}
    # After the start: a, b, end, or the unknown word.
    assert got[6] + got[0] + got[1] + got[2] + got[3] + got[4] + got[5] < 1


def test_language_model_edges(clashing, docs):
    assert lm.score(clashing, F.lit(True)).count() == clashing.count()
    # Rows without an id are dealt over chunks and scored as if they had one.
    ids = docs.sparkSession.range(10_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 997).alias("text"))
    lost = ids.withColumn("doc_id", F.lit(None).cast("long"))
    size = 50 * lm.CHUNK_CHARS
    chunks = lost.groupBy(lm.chunk_of(F.col("doc_id"), F.col("text"), size)).count().collect()
    assert len(chunks) == 51 and max(r["count"] for r in chunks) < 1000
    values = lambda df: sorted((r.n_known, r.base_score, r.score)
                               for r in lm.score(df, F.lit(True)).collect())
    assert values(lost) == values(ids)
    none = lm.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)


# ---- 10 fingerprints ---------------------------------------------------------
def test_fingerprints_of_edits(docs):
    got = {r.doc_id: r for r in spots.compare_with_edits(docs).collect()}
    texts = [t or "" for t in TEXTS + NEAR]
    prints = {}
    for i, t in enumerate(texts):
        r, following = got[i], texts[(i + 1) % len(texts)]
        k = len(t) // 4
        edited = t[:len(t) - k] + following[:k]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new = ({x[j:j + 16] for j in range(0, len(x), 16)}
                    for x in (r.fingerprint, r.edited_fingerprint))
        want = len(own & new) / len(own | new) if own | new else 1.0
        assert math.isclose(r.near_edited, want)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == "") == (not words(t))
    for i in got:
        a, b = ({x[j:j + 16] for j in range(0, len(x), 16)} for x in
                (got[i].fingerprint, got[(i + 1) % len(texts)].fingerprint))
        assert math.isclose(got[i].near_next, len(a & b) / len(a | b) if a | b else 1.0)


def test_fingerprint_blocks_and_edges(spark, clashing):
    ids = [0, 5, 4095, 4096, 20000, 90000]
    rows = [(i, f"text number {i} of the series", None, None, 1) for i in ids]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in spots.compare_with_edits(docs).collect()}
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, f = f"text number {i} of the series", f"text number {nxt} of the series"
        edited = t[:len(t) - len(t) // 4] + f[:len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert spots.compare_with_edits(clashing).count() == clashing.count()
    assert spots.compare_with_edits(docs.limit(0)).count() == 0
    assert spots.compare_with_edits(docs.limit(1)).first().near_next == 1.0


def test_similar_pairs_lose_no_pair(docs):
    sets = {r.doc_id: set(r.s) for r in docs.select("doc_id", spots.spots(F.col("text")).alias("s"))
            .collect()}
    firsts = {}
    for i in sorted(sets):
        firsts.setdefault(frozenset(sets[i]), i)
    for least in (0.3, 0.8):
        want = {(a, b) for a, b in itertools.combinations(sorted(firsts.values()), 2)
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        got = spots.similar_pairs(docs, least).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_similar_pairs_without_unique_ids(spark):
    texts = [f"{prose(80, 40 + i // 2)} the tail{i} end" for i in range(6)]
    rows = [(i, t, None, None, 1) for i, t in zip([None, None, 5, 5, None, 3], texts)]
    got = spots.similar_pairs(spark.createDataFrame(rows, DOCS), 0.8).collect()
    assert sorted(((r.a, r.b) for r in got), key=str) == [(3, None), (5, 5), (None, None)]


def test_schemas_do_not_depend_on_rows(docs):
    out = spots.compare_with_edits(docs.limit(0))
    assert out.schema["near_edited"].dataType == T.DoubleType()


# ---- ids beside a NULL -----------------------------------------------------
def test_large_ids_beside_a_null_id_stay(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    docs = spark.createDataFrame([(i, f"some words {k}", "en", "s", 1) for k, i in enumerate(ids)],
                                 DOCS).coalesce(1)
    got = [r.doc_id for r in lm.score(docs, F.lit(True)).collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)
    blocks = separators.flat_files(docs, VOCAB, public_tokenizers.PATTERN).collect()
    assert [i for b in blocks for i in b.doc_ids] == ids

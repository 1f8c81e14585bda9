"""Document fingerprints from spot signatures (SpotSigs).

Common words are anchors. Each content word that follows an anchor starts a chain of
``CHAIN`` content words; the anchor with its chain is a spot. So that texts in which
the common words are rare have spots too, one word in ``RARE``, chosen by its hash,
starts a chain without an anchor. Case and punctuation do not count. The fingerprint
of a text is the set of its spots, as sorted 64-bit hashes. A text without a spot takes
every word as a content word, and one with fewer words than a chain takes its whole
word sequence; only a text without words has an empty fingerprint.

Two fingerprints are compared by Jaccard similarity. Sets whose lengths differ too
much for the wanted similarity are never compared by ``similar_pairs``: fingerprints are
partitioned by set length, and within reach of each other only those that share a rare
spot meet. ``compare_with_edits`` compares given pairs, without length classes.
All of it is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeline.llm.tables import let, whole, word_list

CHAIN = 2
# Frequent function words of four languages.
ANCHORS = ("the a an of and to in is it that was for on are with as be by this from or at have "
           "der die das und in zu den mit von ist des im dem nicht ein eine auf für als auch "
           "le la les de des et en un une du que est pour dans par sur au il ne pas qui "
           "el los las y del que se por con para una su al lo como más no").split()
_MARK = "\x01"
RARE = 16
#: Ids in a block of neighbours.
BLOCK = 4096


def _chains(words: Column) -> Column:
    """Hashes of the chains that start behind an anchor."""
    # Anchors are glued to the word behind them, so that one split leaves content words.
    chosen = lambda w: F.pmod(F.xxhash64(w), F.lit(RARE)) == 0
    text = F.array_join(F.transform(words, lambda w: F.when(
        w.isin(ANCHORS), F.concat(w, F.lit(_MARK))).when(
        chosen(w), F.concat(F.lit(_MARK), w, F.lit(" "))).otherwise(F.concat(w, F.lit(" ")))), "")
    content = F.filter(F.split(F.rtrim(text), " "), lambda w: w != "")
    last = lambda w: F.substring_index(w, _MARK, -1)

    def of(ws: Column) -> Column:
        each = F.transform(ws, lambda w, i: F.when(F.instr(w, _MARK) > 0, F.xxhash64(
            w, *[last(F.get(ws, i + k)) for k in range(1, CHAIN)])))
        full = F.slice(each, 1, F.greatest(F.size(ws) - (CHAIN - 1), F.lit(0)))
        return F.filter(full, lambda h: h.isNotNull())
    return let(content, of)


def _runs(words: Column) -> Column:
    """Hashes of all chains of a text without anchors."""
    whole_run = F.array(F.xxhash64(words))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(
        F.size(words) < CHAIN, whole_run).otherwise(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - CHAIN + 1, F.lit(1))),
            lambda i: F.xxhash64(F.slice(words, i, F.lit(CHAIN)))))


def spots(text: Column) -> Column:
    """Sorted distinct spot hashes of a whole text; NULL counts as empty."""
    def of(words: Column) -> Column:
        return let(_chains(words), lambda hs: F.when(F.size(hs) > 0, hs).otherwise(_runs(words)))
    lower = F.lower(F.coalesce(text, F.lit("")))
    clean = F.regexp_replace(lower, r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    clean = F.when(F.length(F.btrim(clean)) > 0, clean).otherwise(F.translate(lower, _MARK, ""))
    return F.sort_array(F.array_distinct(let(word_list(clean), of)))


def as_text(fingerprint: Column) -> Column:
    """Sixteen hex digits per spot, in the order of the set."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two fingerprints, 0 where it cannot reach ``least``.

    Two empty fingerprints are alike. The ratio of the lengths bounds the
    similarity, so a pair beyond it is not intersected.
    """
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    value = common / (n + m - common)
    value = F.when((n == 0) & (m == 0), 1.0).when(
        F.least(n, m) < F.lit(least) * F.greatest(n, m), 0.0).otherwise(value)
    return F.when(value >= least, value).otherwise(0.0).cast("double")


def similar_pairs(docs: DataFrame, least: float = 0.8, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(a, b, similarity): all pairs of different fingerprints at ``least`` or above.

    Copies fold to one row per fingerprint. A pair is found by the hashes of its sets and
    shown by the smallest key of each, NULL last; sets of equal or NULL keys keep their
    pairs. Empty fingerprints pair with nothing. Each fingerprint is partitioned by length class
    and sends the rarest spots that a partner must share (prefix filter), ranked by
    how many fingerprints hold them; candidates are compared once.
    """
    sets = (docs.select(F.col(key).alias("id"), spots(F.col(text)).alias("s"))
            .groupBy("s").agg(F.min("id").alias("id")).filter(F.size("s") > 0)
            .withColumn("k", F.xxhash64("s")))
    often = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    held = sets.select("k", F.size("s").alias("len"), F.explode("s").alias("h")).join(often, "h")
    ranked = held.groupBy("k", "len").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("r"))
    needed = F.col("len") - F.ceil(F.col("len") * F.lit(least)) + 1
    # Length classes grow by 1/least; partners lie in the same or the next class.
    band = F.floor(F.log(F.col("len").cast("double")) / F.lit(-math.log(least)) + 1e-9)
    probes = ranked.select("k", band.alias("band"), F.explode(
        F.transform(F.slice("r", F.lit(1), needed.cast("int")), lambda x: x["h"])).alias("h"))
    left = probes.select(F.col("k").alias("a"), F.col("band").alias("la"), "h")
    right = probes.select(F.col("k").alias("b"), F.explode(
        F.array(F.col("band"), F.col("band") - 1)).alias("la"), F.col("band").alias("lb"), "h")
    cand = (left.join(right, ["h", "la"]).filter((F.col("lb") > F.col("la")) | (F.col("a") < F.col("b")))
            .filter("a <> b").select("a", "b").distinct())
    side = lambda k: sets.select(F.col("k").alias(k), F.struct(
        F.col("id").isNull().alias("unnamed"), "id", F.lit(k).alias("side")).alias(f"n{k}"),
        F.col("s").alias(f"s{k}"))
    cand = cand.join(side("a"), "a").join(side("b"), "b")
    out = cand.select(F.least("na", "nb")["id"].alias("a"), F.greatest("na", "nb")["id"].alias("b"),
                      jaccard(F.col("sa"), F.col("sb"), least).alias("similarity"))
    return out.filter(F.col("similarity") > 0)


def with_next(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``next_text``, the whole text of the document with the next larger id.

    The last document is followed by the first. Ids are cut into blocks; inside one
    a window looks ahead, and a copy of the first row of the next block that holds
    any stands at its end. One task sees one id per block when blocks are put in
    order. NULL ids come first; rows of one id follow in text order.
    """
    number = F.coalesce(F.floor(F.col("doc_id") / block), F.lit(-(1 << 62)))
    rows = docs.select(number.alias("block"), F.lit(0).alias("guest"), "doc_id", whole().alias("text"))
    first = rows.groupBy("block").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    order = Window.orderBy("block")
    ends = first.select("block").withColumn("to", F.lag("block").over(order))
    final = first.agg(F.max("block").alias("m")).scalar()
    ends = ends.withColumn("to", F.coalesce("to", final))
    guests = first.join(ends, "block").select(F.col("to").alias("block"), F.lit(1).alias("guest"),
                                              F.col("f.doc_id").alias("doc_id"),
                                              F.col("f.text").alias("text"))
    return rows.unionByName(guests)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text ends in the beginning of the next document's text instead of its
    own last quarter. Texts move once, to their block.
    """
    near = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    own = with_next(docs).withColumn("fp", spots(F.col("text")))
    own = own.withColumns({"next_text": F.lead("text").over(near), "next_fp": F.lead("fp").over(near)})
    own = own.filter("guest = 0").withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")),
                      F.substring(F.col("next_text"), F.lit(1), cut))
    own = own.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    own = own.withColumn("edited_fp", spots(F.col("edited")))
    return own.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        jaccard(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        jaccard(F.col("fp"), F.col("next_fp")).alias("near_next"))

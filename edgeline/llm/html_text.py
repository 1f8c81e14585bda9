"""Main text of web pages by site template removal.

Every element subtree of a page is hashed, inside the article too, and counted per
host. A subtree that recurs in ``MIN_PAGES`` different contexts of its host is template
and is deleted, whatever the size of the host. Its context is what surrounds it: inside
an article a sketch of the rest of the article, elsewhere the text of the page. Copies
of one article or page are one context, so an article copied to several pages of a host
stays. Not counted inside an article are inline elements, subtrees below ``LEAST_WORDS``
words, which recur by chance, and those that are the body of the article.

What a page shares with no other page of its host is told apart by its element, class,
id or role (menus, adverts, comments and so on). Inside an article a class name decides
only if all its words are such words, so ``related-work`` stays. Where a page has an
article, what lies outside of it is left out by that alone; an article that is a reader's
comment is none.

A page is scanned once, from left to right and without recursion, whatever its nesting
or markup. The scan gives the page's text and the spans of its subtrees in it, which is
all that is written, counted and cut.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.tables import materialise

#: A subtree is template on a host if it recurs in at least MIN_PAGES contexts.
MIN_PAGES = 4
#: Words of the smallest subtree that is counted inside an article.
LEAST_WORDS = 3
#: A subtree with this many words and more than half of its article is the body.
BODY_WORDS = 50
#: Words whose hashes a task remembers, and rows that a hot host is dealt over.
REMEMBERED = 200_000
SALTS = 16
_FAR = np.uint64((1 << 64) - 1)
_LOW = np.uint64((1 << 32) - 1)

# Element and attribute names of the markup language.
RAW = "script style noscript template iframe svg textarea select title".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav header footer aside form button menu dialog object canvas audio "
                    "video math".split()) | frozenset(RAW)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert "
                  "alertdialog form toolbar".split())
MARKS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs header masthead banner "
                  "footer sidebar aside rail widget widgets ad ads advert adverts advertisement "
                  "advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
                  "notice notices popup modal overlay newsletter subscribe subscription signup "
                  "login search share sharing social comment comments disqus respond replies "
                  "related recommended recommendations pagination pager toolbar skip "
                  "copyright legal disclaimer".split())
#: Words that a class name may add to a mark without changing what it means.
PLAIN = frozenset("area bar block box button buttons cell col column container content div group "
                  "holder inner item items label left link links list main outer page panel "
                  "post posts right row section site slot text title top bottom unit wrap "
                  "wrapper".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
#: End tags that a start tag of the same group implies.
CLOSED_BY = {"p": frozenset("p div ul ol dl table section article aside header footer nav form "
                            "main h1 h2 h3 h4 h5 h6 blockquote pre hr figure fieldset".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
             "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# Possessive parts, so no piece of markup is read twice; what is not closed ends with the page.
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))"
    r"|<(?P<end>/)?(?P<tag>[a-z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.I | re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))",
                   re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENCLOSING = frozenset(["article", "main", "body"])


def _marked(tag: str, attrs: str, inside: bool) -> bool:
    """Whether element, class, id or role tell that an element is no main text."""
    if tag in DROPPED:
        return True
    for name, a, b, c in _ATTR.findall(attrs) if "=" in attrs else ():
        value = a or b or c
        if name.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
            continue
        if tag in ("html", "body", "main"):
            continue
        for token in value.split():
            words = [w.lower() for w in _NAME.findall(token)]
            marks = MARKS if tag != "article" else COMMENTS
            hits = sum(w in marks for w in words)
            if hits and (not (inside or tag == "article")
                         or all(w in marks or w in PLAIN for w in words)):
                return True
    return False


class Page:
    """Elements of a page in document order, without what is dropped by its name.

    ``items`` holds texts, ``i`` where element ``i`` begins and ``~i`` where it ends.
    """
    __slots__ = ("tags", "parents", "items")

    def __init__(self):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.items: list[str | int] = []


def parse(page: str) -> Page:
    """Scans a page; unclosed and stray tags are repaired as browsers do."""
    out = Page()
    tags, parents, items = out.tags, out.parents, out.items
    stack: list[tuple[str, int]] = []          # open elements: tag and number, -1 if dropped
    where: dict[str, list[int]] = defaultdict(list)       # their places in the stack, by tag
    solid: list[int] = []                      # places of those that are not inline
    walls: list[int] = []                      # places of articles, mains and bodies
    hidden = -1                                # place of the outermost dropped element

    def close(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            tag, number = stack.pop()
            place = len(stack)
            where[tag].pop()
            if solid and solid[-1] == place:
                solid.pop()
            if walls and walls[-1] == place:
                walls.pop()
            if number >= 0:
                items.append(~number)
            elif hidden == place:
                hidden = -1
                if tag not in INLINE:
                    items.append(" ")

    def say(text: str) -> None:
        items.append(html.unescape(text) if "&" in text else text)

    at, search = 0, _MARKUP.search
    while m := search(page, at):
        if m.start() > at and hidden < 0:
            say(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            places = where.get(tag)
            # A stray end tag stays inside its article.
            if places and (tag in ("body", "html") or not walls or places[-1] >= walls[-1]):
                close(places[-1])
            continue
        attrs = m["attrs"]
        if tag in _RAW_END:
            if not (tag == "svg" and attrs.endswith("/")):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            if solid and tag in CLOSED_BY.get(stack[solid[-1]][0], ()):
                close(solid[-1])               # inline elements end with their block
        number = -1
        if hidden < 0 and not _marked(tag, attrs, bool(where["article"])):
            number = len(tags)
            tags.append(tag)
            parents.append(stack[-1][1] if stack else -1)
            items.append(number)
        if tag in VOID or attrs.endswith("/"):
            if number >= 0:
                items.append(~number)
            elif hidden < 0 and tag not in INLINE:
                items.append(" ")
            continue
        place = len(stack)
        if hidden < 0 and number < 0:
            hidden = place
            if tag not in INLINE:
                items.append(" ")
        stack.append((tag, number))
        where[tag].append(place)
        if tag not in INLINE:
            solid.append(place)
        if tag in _ENCLOSING:
            walls.append(place)
    if hidden < 0 and at < len(page):
        say(page[at:])
    close(0)
    return out


def _articles(page: Page) -> tuple[list[bool], list[bool]]:
    """For each element: whether it is an outermost article, and whether it holds one.

    A main element counts as one where it holds no article.
    """
    n = len(page.tags)
    article, main = [False] * n, [False] * n
    for i in range(n - 1, -1, -1):             # parents stand before their children
        if (p := page.parents[i]) >= 0:
            article[p] |= article[i] or page.tags[i] == "article"
            main[p] |= main[i] or page.tags[i] in ("article", "main")
    top, inside = [False] * n, [False] * n
    for i in range(n):
        p = page.parents[i]
        inside[i] = p >= 0 and (inside[p] or top[p])
        top[i] = not inside[i] and (page.tags[i] == "article"
                                    or (page.tags[i] == "main" and not article[i]))
    return top, main


class _Words(dict):
    """Hashes of the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def _sketches(pieces: list[list[str]], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Two minimum hashes of the three-word shingles of every piece of text."""
    sizes = np.array([len(p) for p in pieces])
    w = np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), dtype=np.uint64,
                    count=sizes.sum())
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(w))      # words to the piece's end
    code = w * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        later = np.where(left[:max(len(w) - k, 0)] > k, w[k:], np.uint64(0))
        code[:len(later)] = (code[:len(later)] ^ (code[:len(later)] >> np.uint64(31))
                             ^ later) * np.uint64(factor)
    code ^= code >> np.uint64(29)
    whole = left >= 3
    whole[starts] = True                       # a short piece is one shingle
    low = np.where(whole, code & _LOW, _FAR)
    high = np.where(whole, code >> np.uint64(32), _FAR)
    return np.minimum.reduceat(low, starts), np.minimum.reduceat(high, starts)


def _contexts(pieces: list[list[str]], spans: list[tuple[int, int]], known: _Words) -> list[int]:
    """Sketch of an article without the pieces a..b, for every span (a, b)."""
    both = []
    for each in _sketches(pieces, known):
        before = np.minimum.accumulate(np.concatenate([[_FAR], each]))
        after = np.minimum.accumulate(np.concatenate([each, [_FAR]])[::-1])[::-1]
        a, b = np.array(spans).T
        both.append(np.minimum(before[a], after[b]) & _LOW)
    return ((both[0] << np.uint64(32)) | both[1]).view(np.int64).tolist()


def scan(page: str | None, known: _Words | None = None,
         sketch: bool = True) -> tuple[str, list[int]]:
    """Text of a page's articles, or of the whole page, and its subtrees.

    The list holds (hash, context, start, end) in turn for every subtree that may be
    template; start and end are places in the text, equal outside of it. Without
    ``sketch`` it stays empty.
    """
    parsed = parse(page or "")
    known = _Words() if known is None else known
    top, holds = _articles(parsed)
    tags = parsed.tags
    whole = not any(top)
    text: list[str] = []
    length, article = 0, -1
    open_: list[tuple[list[str], int, int]] = [([], 0, 0)]
    pieces: list[list[str]] = []               # texts of the article
    outside = 0                                # number of texts outside
    upto = [0]                                 # words before each piece of the article
    seen: list[tuple[int, int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    found: list[int] = []
    every = xxhash.xxh64()

    def put(part: str) -> None:
        nonlocal length
        if whole or article >= 0:
            text.append(part)
            length += len(part)

    for item in parsed.items:
        if isinstance(item, str):
            if words := item.split():
                run = " ".join(words)
                if sketch:
                    every.update(run.encode("utf-8", "surrogatepass") + b" ")
                    open_[-1][0].append(run)
                if article >= 0:
                    pieces.append(words)
                    upto.append(upto[-1] + len(words))
                else:
                    outside += 1
                put(f"{' ' if item[0].isspace() else ''}{run}{' ' if item[-1].isspace() else ''}")
            elif item:
                put(" ")
        elif item >= 0:
            if tags[item] not in INLINE:
                put(" ")
            if top[item]:
                article, pieces, upto = item, [], [0]
            open_.append(([], length, len(pieces) if article >= 0 else outside))
        else:
            i = ~item
            tag = tags[i]
            parts, start, first = open_.pop()
            if not sketch:
                article = -1 if top[i] else article
                if tag not in INLINE:
                    put(" ")
                continue
            name = f"<{tag}>{' '.join(parts)}</>"
            code = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))
            open_[-1][0].append(name if len(name) <= 64 else f"<{tag}#{code:x}>")
            if top[i]:
                kept = [s for s in seen if s[3] >= LEAST_WORDS
                        and not (s[3] >= BODY_WORDS and 2 * s[3] > upto[-1])]
                if kept:
                    contexts = _contexts(pieces, [s[4:] for s in kept], known)
                    for (code, start, end, *_), c in zip(kept, contexts):
                        found += code - (1 << 63), c, start, end
                article, seen = -1, []
            elif article >= 0:
                if tag not in INLINE and tag != "br" and tag != "main" and len(pieces) > first:
                    seen.append((code, start, length, upto[-1] - upto[first], first, len(pieces)))
            elif tag not in ("html", "body", "main", "br") and not holds[i] and outside > first:
                rest.append((code, start, length))
            if tag not in INLINE:
                put(" ")
    context = every.intdigest() - (1 << 63)
    for code, start, end in rest:
        found += code - (1 << 63), context, start, end
    return "".join(text), found


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A scanned text without some spans, its white space turned into single spaces."""
    parts, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            parts.append(text[at:start])
        at = max(at, end)
    parts.append(text[at:])
    return " ".join("".join(parts).split())


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]+://(?:[^@/?#]*@)?([^/:?#]*)", 1),
                              F.lit("")))


def _keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with their host, a 128-bit key of host and page, and a salt."""
    site = host(F.col("url"))
    key = F.struct(*[F.xxhash64(F.lit(k), site, F.col("html")).alias(f"k{k}") for k in (1, 2)])
    return pages.select("*", site.alias("__host"), key.alias("__key"), F.pmod(
        F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("__salt"))


def scanned(pages: DataFrame) -> DataFrame:
    """(hash, context, start, end) of the subtrees of every page, written once.

    Copies of a page on one host share key and subtrees; no text is written.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Words()
        for batch in batches:
            yield pd.Series([scan(p, known)[1] for p in batch], dtype=object)

    rows = _keyed(pages.select("url", "html").filter(F.length("html") > 0)).select(
        F.col("__key").alias("key"), F.col("__host").alias("host"), F.col("__salt").alias("salt"),
        F.pandas_udf(run, "array<long>")("html").alias("found"))
    return materialise(rows, "page-subtrees")


def _subtrees(trees: DataFrame) -> DataFrame:
    fields = ("hash", "context", "start", "end")
    each = F.transform(F.sequence(F.lit(0), F.size("found") - 4, F.lit(4)), lambda i: F.struct(
        *[F.get("found", i + k).alias(name) for k, name in enumerate(fields)]))
    # Not filtered before it is written: Spark would call the function for the filter again.
    return trees.filter(F.size("found") > 0).select("key", "host", "salt", F.inline(each))


def templates(trees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash) of the subtrees that recur in ``min_pages`` contexts of a host.

    ``trees`` as ``scanned`` gives them. Contexts are made distinct and counted with
    map-side combine, so a host with a third of all pages is not gathered.
    """
    return (_subtrees(trees).select("host", "hash", "context").distinct()
            .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_pages).select("host", "hash"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Every row with ``text``, the main text of the whole page, instead of ``html``.

    NULL and empty pages give an empty text; pages without a host share the empty
    one. Repeated rows stay, an older ``text`` gives way, any other column passes.
    Subtrees meet the templates by host, hash and a salt; what comes back to a page, by
    its key and a salt, is the spans to cut. Texts travel compressed.
    """
    trees = scanned(pages)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    cuts = (_subtrees(trees).filter(F.col("end") > F.col("start"))
            .join(templates(trees, min_pages).withColumn("salt", salts), ["host", "hash", "salt"])
            .groupBy("key").agg(F.flatten(F.collect_set(F.array("start", "end"))).alias("cuts"))
            .withColumn("salt", salts))

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pd.Series([press.compress(scan(p, sketch=False)[0].encode("utf-8", "replace"))
                             for p in batch], dtype=object)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        open_ = zstandard.ZstdDecompressor()
        for texts, spans in batches:
            yield pd.Series([cut(open_.decompress(t).decode("utf-8"),
                                 () if c is None else list(zip(c[::2], c[1::2])))
                             for t, c in zip(texts, spans)], dtype=object)

    kept = [F.col(c) for c in pages.columns if c not in ("html", "text")]
    rows = _keyed(pages).select(F.struct(*kept).alias("row"), F.col("__key").alias("key"),
                                F.col("__salt").alias("salt"),
                                F.pandas_udf(pack, "binary")("html").alias("packed"))
    done = rows.join(cuts, ["key", "salt"], "left")
    return done.select("row.*", F.pandas_udf(run, "string")("packed", "cuts").alias("text"))

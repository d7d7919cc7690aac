"""Main text of pages by wrapper induction.

The blocks of a page lie in a tree in which like siblings in a row are one repeated slot (``html_tree``),
template or content as a whole. Per host the tree that most distinct pages have is the wrapper's; all other
trees of the host are aligned to it by simple tree matching. Over the host's distinct pages, a node whose text is the same on nine of ten pages
that have it is template, a slot whose text varies is content. The text of a page is what its varying slots
hold, apart from parts that HTML or their names mark as no part of the article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, comments), and within its ``article`` or ``main`` where it has one.

Copies of a page count once, so that they don't make their own text a template. A slot needs LEAST pages to
be template; headings need HEADING pages. Within a marked article only slots of elements that do not stand for
running text can be template, from IN_ARTICLE pages on: a host may hold many copies of one article, and versions
of it share its title.

Only trees' shapes and hashes of texts are shuffled to find the wrappers; votes are added up per task before
they meet, and each distinct shape of a host is aligned once. Wrappers are written, so their size is known
when pages are joined to them: below Spark's limit they are broadcast, else pages meet them by host and shape.

Defined results: a null html is empty, and an empty page has an empty text; a page without a host (null or
relative url) has no wrapper, nor has one whose host has fewer distinct pages than a template needs; rows that
are repeated have equal results; pages of any length are read whole; unclosed and misnested markup is read
like browsers do (without moving text out of tables); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import keyed_schema, materialize
from trackmill.llm.html_tree import HEADINGS, Block, Page

#: Distinct pages that a slot needs to be template: outside an article, headings there, in an article.
LEAST, HEADING, IN_ARTICLE = 3, 5, 8
#: Share of the pages with a node that agree on a template's text.
AGREE = 0.9
#: Elements of running text.
RUNNING = HEADINGS | frozenset("p li dt dd blockquote pre td th caption figcaption".split())
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


# tree matching


def _scores(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Best weight of an alignment in order of all of ``a`` with each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight[x, b]))
    return row


def _pairs(a: np.ndarray, b: np.ndarray, weight: np.ndarray, i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """The pairs of a best alignment in order, in memory linear in the lengths (divide and conquer)."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        best = int(weight[a[0], b].argmax())
        return [(i, j + best)] if weight[a[0], b[best]] else []
    half = len(a) // 2
    cut = int((_scores(a[:half], b, weight) + _scores(a[half:][::-1], b[::-1], weight)[::-1]).argmax())
    return _pairs(a[:half], b[:cut], weight, i, j) + _pairs(a[half:], b[cut:], weight, i + half, j + cut)


class _Tree:
    """A shape with equal subtrees numbered alike, so that a pair of subtrees is matched once."""

    def __init__(self, shape: list, names: dict) -> None:
        self.children = [_Tree(c, names) for c in shape[1]]
        self.key = shape[0]
        self.size = 1 + sum(c.size for c in self.children)
        self.kind = names.setdefault((self.key, *(c.kind for c in self.children)), len(names))


class Matcher:
    """Simple tree matching: roots agree, and children are aligned in order for the most matched nodes."""

    def __init__(self, a: str, b: str) -> None:
        self.names: dict = {}
        self.a, self.b = _Tree(json.loads(a), self.names), _Tree(json.loads(b), self.names)
        self.known: dict[tuple[int, int], int] = {}

    def _children(self, a: _Tree, b: _Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ka, ia = np.unique([c.kind for c in a.children], return_inverse=True)
        kb, ib = np.unique([c.kind for c in b.children], return_inverse=True)
        of_a, of_b = {c.kind: c for c in a.children}, {c.kind: c for c in b.children}
        weight = np.zeros((len(ka), len(kb)), np.int64)
        by_key: dict[str, list[int]] = {}
        for y, k in enumerate(kb):
            by_key.setdefault(of_b[k].key, []).append(y)
        for x, k in enumerate(ka):
            for y in by_key.get(of_a[k].key, []):
                weight[x, y] = self.size(of_a[k], of_b[kb[y]])
        return ia, ib, weight

    def size(self, a: _Tree, b: _Tree) -> int:
        """Nodes of the largest match of two trees."""
        if a.key != b.key:
            return 0
        if a.kind == b.kind:
            return a.size
        if (a.kind, b.kind) not in self.known:
            best = 0
            if a.children and b.children:
                ia, ib, weight = self._children(a, b)
                best = int(_scores(ia, ib, weight)[-1])
            self.known[a.kind, b.kind] = 1 + best
        return self.known[a.kind, b.kind]

    def mapping(self) -> list[int]:
        """For each node of the first tree (in preorder) the node of the second that it is matched with, or -1."""
        out = [-1] * self.a.size
        todo = [(self.a, 0, self.b, 0)] if self.a.key == self.b.key else []
        while todo:
            a, i, b, j = todo.pop()
            out[i] = j
            if a.kind == b.kind:
                out[i : i + a.size] = range(j, j + a.size)
            elif a.children and b.children:
                at_a = i + 1 + np.cumsum([0] + [c.size for c in a.children])
                at_b = j + 1 + np.cumsum([0] + [c.size for c in b.children])
                for x, y in _pairs(*self._children(a, b)):
                    todo.append((a.children[x], int(at_a[x]), b.children[y], int(at_b[y])))
        return out


# Spark


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def shape_digest(shape: str) -> bytes:
    return hashlib.sha256(shape.encode("utf-8", "surrogatepass")).digest()[:16]


def _pages(column: pa.Array) -> Iterator[Page]:
    for text in column:
        yield Page(text.as_py() or "")


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, shape and the texts' hashes by slot of each page."""
    for batch in batches:
        shapes, slots, digests = [], [], []
        for page in _pages(batch.column(1)):
            shapes.append(page.shape)
            held = {b.slot: b.digest for b in page.blocks}
            slots.append(list(held))
            digests.append(list(held.values()))
        ids = pa.array([shape_digest(s) for s in shapes], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(shapes, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.int64()))], names=["host", "shape_id", "shape", "slots", "digests"])


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [Matcher(a, b).mapping() for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.list_(pa.int32()))], names=["host", "shape_id", "places"])


def wrappers(pages: DataFrame) -> DataFrame:
    """Per host and shape of tree: ``template``, an array of (slot, digest of its text, pages that have it)."""
    narrow = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host != ''")
    profiles = narrow.mapInArrow(_profiles, "host string, shape_id binary, shape string, slots array<int>, digests array<long>")
    distinct = materialize(profiles.groupBy("host", "shape_id", "slots", "digests").agg(F.first("shape").alias("shape")), "profiles")
    shapes = distinct.groupBy("host", "shape_id").agg(F.count("*").alias("n"), F.first("shape").alias("shape"))
    seeds = shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape_id")).alias("seed"))
    aligned = shapes.join(seeds, "host").select("host", "shape_id", "shape", "seed").mapInArrow(_alignments, "host string, shape_id binary, places array<int>")
    aligned = materialize(aligned, "aligned")
    held = distinct.join(aligned, ["host", "shape_id"]).select("host", "places", F.explode(F.arrays_zip("slots", "digests")).alias("s"))
    held = held.select("host", F.col("places")[F.col("s.slots")].alias("place"), F.col("s.digests").alias("digest")).filter("place >= 0")
    votes = held.groupBy("host", "place", "digest").agg(F.count("*").alias("n"))
    places = votes.groupBy("host", "place").agg(F.sum("n").alias("pages"), F.max("n").alias("most"), F.max_by("digest", F.struct("n", "digest")).alias("digest"))
    constant = places.filter((F.col("pages") >= LEAST) & (F.col("most") >= AGREE * F.col("pages")))
    spots = aligned.select("host", "shape_id", F.posexplode("places").alias("slot", "place")).filter("place >= 0")
    template = spots.join(constant, ["host", "place"]).groupBy("host", "shape_id")
    return template.agg(F.collect_list(F.struct("slot", "digest", "pages")).alias("template"))


def _needed(block: Block) -> int | None:
    """Pages on which a block's slot must be constant to be template; None: it is never template."""
    if block.article or block.main:
        return None if block.tag in RUNNING else IN_ARTICLE
    return HEADING if block.tag in HEADINGS else LEAST


PART = pa.struct([("slot", pa.int32()), ("digest", pa.int64()), ("needed", pa.int64()), ("text", pa.string())])


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts = [], []
        for page in _pages(batch.column("html")):
            ids.append(shape_digest(page.shape))
            parts.append([{"slot": b.slot, "digest": b.digest, "needed": _needed(b), "text": b.text} for b in page.article()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary()), pa.array(parts, pa.list_(PART))], names=["page_id", "url", "host", "shape_id", "parts"])


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    templates = materialize(wrappers(pages), "wrappers")
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    kind = dict(pages.dtypes)["url"]
    schema = keyed_schema(read, f"url {kind}, host string, shape_id binary, parts array<struct<slot int, digest long, needed long, text string>>")
    parts = read.mapInArrow(_articles, schema)
    found = parts.join(templates, ["host", "shape_id"], "left")
    taken = lambda p: F.exists("template", lambda t: (t.slot == p.slot) & (t.digest == p.digest) & (t.pages >= p.needed))
    kept = F.filter("parts", lambda p: ~F.coalesce(taken(p), F.lit(False)))
    out = found.select("page_id", "url", F.array_join(F.transform(kept, lambda p: p.text), "\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


#: The pages of the test tables hold their article in one element of headings and paragraphs.
ORACLE = r"""
WITH parts AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:h1|p)>') parts FROM pages),
bare AS (SELECT page_id, url, list_transform(parts, lambda p: regexp_replace(replace(p, '<br>', ' '), '<[^>]*>', '', 'g')) parts FROM parts),
decoded AS (SELECT page_id, url, list_transform(parts, lambda p: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  p, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);?', '''', 'g'), '&amp;?', '&', 'g')) parts FROM bare),
plain AS (SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) parts FROM decoded),
texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda p: p != ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT n_chars FROM texts
"""

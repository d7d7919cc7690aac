"""The trie of conversation prefixes: nodes by chained digests, sums over subtrees.

Every conversation's turns are hashed where they lie; only hashes and word counts are shuffled. A task
streams the conversations of a family (ids with one ``c - c % 20``) in order and chains the hashes, so that
the d-th digest stands for the sequence of the first d turns; all prefixes are exploded as rows, and rows
that agree on (depth, digest) are one node.

A node belongs to its smallest member. A member that is smallest at some depth stays smallest down to its
own end, so each conversation owns one run of nodes, from its first own depth to its end, or none. For sums
over subtrees every node is exploded to all its ancestors, in two parts that are added up first: within its
run by a running sum, and above the run once for the whole run, on the owner's prefixes that others own.
So there are no more such rows than prefixes, whatever the depth.

Defined results: rows without a conversation id belong to no conversation; null turns come first, rows of
one turn in the order of their digests, repeated rows are turns of their own; null roles and texts are
empty; a conversation whose rebuilt form has no turns ends at the root; an empty table has no nodes.
Ids are whole numbers, remainders those of SQL (of the dividend's sign). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.common import materialize

#: A conversation takes up to SHARED - 1 first turns from the first conversation of its FAMILY.
FAMILY, SHARED = 20, 4
#: Conversation ids in one piece of a list of ends: 2 ** PIECE_BITS consecutive numbers.
PIECE_BITS = 12
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.sha256(b"").digest()

PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("words", pa.int64()), ("ends", pa.int64())])
#: SHA-256 of nothing, as of nodes at which no conversation ends.
NO_ENDS = ROOT.hex()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of (role, text), words of the text: all that the trie reads of a turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(both.cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
        (F.crc32(F.col("conv_id").cast("long").cast("string").cast("binary")) % SHARED).alias("shared"),
    )


class _Chain:
    """The prefixes of conversations that come turn by turn, a family's first conversation first."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.conv: int | None = None
        self.first: list[tuple[bytes, int]] = []  # the first turns of the family's first conversation
        self.rows: tuple[list, ...] = tuple([] for _ in PREFIXES)

    def turn(self, base: int, conv: int, shared: int, digest: bytes, words: int) -> None:
        if conv != self.conv:
            self.end()
            if base != self.base:
                self.base, self.first = base, []
            self.conv, self.own, self.depth, self.digest, self.words = conv, 0, 0, ROOT, 0
            if conv != base:
                for d, w in self.first[:shared]:
                    self.step(d, w)
        self.own += 1
        if conv == base:
            if len(self.first) < SHARED:
                self.first.append((digest, words))
            self.step(digest, words)
        elif self.own > shared:
            self.step(digest, words)

    def step(self, digest: bytes, words: int) -> None:
        self.prefix(0)
        self.depth += 1
        self.digest, self.words = hashlib.sha256(self.digest + digest).digest(), words

    def prefix(self, ends: int) -> None:
        for column, value in zip(self.rows, (self.conv, self.depth, self.digest, self.words, ends), strict=True):
            column.append(value)

    def end(self) -> None:
        if self.conv is not None:
            self.prefix(1)
            self.conv = None

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, tuple([] for _ in PREFIXES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, PREFIXES, strict=True)], schema=PREFIXES)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain = _Chain()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chain.turn(*row)
        yield chain.taken()
    chain.end()
    yield chain.taken()


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth, digest, words of its last text, and
    whether the conversation ends there (0 or 1). The empty prefix of each is among them."""
    turns = turn_digests(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    dealt = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "digest")
    ddl = "conv_id long, depth long, digest binary, words long, ends long"
    return dealt.select("base", "conv_id", "shared", "digest", "words").mapInArrow(_chained, ddl)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order, joined by commas; one piece is held at a time."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        keys, hashes = [], []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["digest", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids. Ids of one range of numbers make a piece
    of bounded length before they meet the node's other pieces, which a task reads one by one."""
    ends = paths.filter("ends = 1").groupBy("digest", F.shiftright("conv_id", PIECE_BITS).alias("place"))
    pieces = ends.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("piece"))
    return pieces.repartition("digest").sortWithinPartitions("digest", "place").select("digest", "piece").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the digest of the path."""
    rows = materialize(prefixes(conversations), "prefixes")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.sum("ends").alias("n_ends"))
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    runs = nodes.select(
        "*",
        F.sum((F.col("n_convs") - 1) * F.col("words")).over(upward.rowsBetween(Window.unboundedPreceding, 0)).alias("saved"),
        F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).over(upward.rowsBetween(Window.unboundedPreceding, 0)).alias("leaves"),
        (F.row_number().over(upward) > 1).cast("long").alias("children"),
        F.lead("depth").over(upward).isNull().alias("top"),
    )
    runs = materialize(runs, "runs")
    tops = runs.filter("top").select("conv_id", F.col("depth").alias("first"), "saved", "leaves")
    above = rows.join(tops, "conv_id").filter("depth < first")
    above = above.select("conv_id", "depth", "digest", "saved", "leaves", (F.col("depth") == F.col("first") - 1).cast("long").alias("children"))
    links = above.filter("children = 1").select("conv_id", "digest").join(runs.select("digest", F.col("conv_id").alias("parent")), "digest").select("conv_id", "parent")
    within = runs.filter(~F.col("top")).withColumn("parent", F.col("conv_id"))
    own = runs.filter("top").join(links, "conv_id", "left").unionByName(within)
    none = F.lit(None).cast("long")
    parts = own.select("depth", "digest", "conv_id", "parent", "n_convs", "saved", "leaves", "children").unionByName(
        above.select("depth", "digest", none.alias("conv_id"), none.alias("parent"), none.alias("n_convs"), "saved", "leaves", "children")
    )
    summed = parts.groupBy("depth", "digest").agg(
        F.max("conv_id").alias("conv_id"),
        F.max("parent").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.sum("children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    out = summed.join(end_digests(rows), "digest", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"),
    )


def trie_table(conversations: DataFrame) -> DataFrame:
    return trie(conversations).drop("digest")


#: crc32 is spelled out: each byte is taken in, then eight bits are shifted out (-1 stands for a shift).
ORACLE = f"""
WITH turns AS MATERIALIZED (
  SELECT conv_id c, conv_id - conv_id % {FAMILY} base, coalesce(text, '') txt,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) dig,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (
  SELECT c, base, xor(list_reduce([4294967295] || flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % {SHARED} h
  FROM (SELECT DISTINCT c, base FROM turns)),
rebuilt AS (
  SELECT convs.c, 0 own, n, dig, txt FROM convs JOIN turns ON turns.c = convs.base AND n <= h
  UNION ALL SELECT convs.c, 1 own, n, dig, txt FROM convs JOIN turns USING (c) WHERE n > h),
paths AS MATERIALIZED (
  SELECT c, 0 d, '' k, 0 w FROM convs
  UNION ALL SELECT c, row_number() OVER o d, string_agg(dig, '') OVER o k,
    length(regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+')) w
  FROM rebuilt WINDOW o AS (PARTITION BY c ORDER BY own, n ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT c, max(d) d FROM paths GROUP BY c),
ended AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) s FROM paths JOIN ends USING (c, d) GROUP BY k),
nodes AS MATERIALIZED (SELECT k, d, min(c) c, count(*) n, max(w) w FROM paths GROUP BY k, d),
edges AS MATERIALIZED (SELECT nodes.k, up.k up FROM nodes JOIN paths up ON up.c = nodes.c AND up.d = nodes.d - 1),
kids AS (SELECT up k, count(*) kids FROM edges GROUP BY up),
sums AS (
  SELECT up.k, sum((nodes.n - 1) * nodes.w) saved, count(*) FILTER (kids.kids IS NULL) leaves
  FROM nodes LEFT JOIN kids USING (k) JOIN paths up ON up.c = nodes.c AND up.d <= nodes.d GROUP BY up.k)
SELECT nodes.c conv_id, nodes.d::BIGINT depth, above.c parent_conv_id, nodes.n n_convs, coalesce(kids.kids, 0) n_children,
  leaves n_leaves, saved::BIGINT saved_tokens, coalesce(s, sha256('')) ends_sha256
FROM nodes JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN ended USING (k)
LEFT JOIN edges USING (k) LEFT JOIN nodes above ON above.k = edges.up
"""

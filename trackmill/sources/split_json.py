"""One large JSON document over many tasks.

A document is cut into ranges of bytes, wherever they fall. Whether a range begins inside a text, after a
backslash or at which depth depends on all bytes before it, so each range is first read under all three
assumptions (outside texts, inside one, inside one after a backslash) and says how each would leave it; a
scan over the ranges, a few numbers each, tells which held. With that each range names the members of the
outer object that begin in it and counts the elements of arrays there, and a second scan gives every range
the member it begins in and the number of its first element. A task then parses the elements that begin in
its range, reading on past its end for the last one.

Quotes, brackets and backslashes are never part of a longer UTF-8 sequence, so all of this is done on bytes;
only whole elements are decoded. A task holds a piece of a few MB and the element that goes on.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.operators.groups import Columns, over_groups
from trackmill.sources.scratch import kept, opened

RANGE, PIECE = 32 << 20, 4 << 20
#: States at a cut.
OUTSIDE, INSIDE, ESCAPED = range(3)
_SIGN = np.zeros(256, bool)
_SIGN[list(b"{}[],:")] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_SPACE = b" \t\n\r"
QUOTE, BACKSLASH, COMMA, COLON, OPEN, CLOSE, BRACKET, END = b'"\\,:{}[]'


def signs(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Places of brackets, commas and colons outside texts, and the state after the last byte."""
    quotes, back = np.flatnonzero(data == QUOTE), np.flatnonzero(data == BACKSLASH)
    head = int(state == ESCAPED)  # as if a backslash stood before the first byte

    def escapes(ends: np.ndarray) -> np.ndarray:
        """Whether an odd number of backslashes ends before each place."""
        if not len(back):
            return (ends == 0) & bool(head)
        new = np.r_[True, np.diff(back) != 1]
        first = back[np.maximum.accumulate(np.where(new, np.arange(len(back)), 0))]
        at = np.searchsorted(back, ends - 1)
        found = (at < len(back)) & (back[np.minimum(at, len(back) - 1)] == ends - 1) & (ends > 0)
        begin = np.where(found, first[np.minimum(at, len(back) - 1)], ends)
        return (ends - begin + head * (begin == 0)) % 2 == 1

    quotes = quotes[~escapes(quotes)]
    inside = int(state != OUTSIDE)
    places = np.flatnonzero(_SIGN[data])
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    if (len(quotes) + inside) % 2 == 0:
        return places, OUTSIDE
    return places, ESCAPED if escapes(np.array([len(data)]))[0] else INSIDE


def pieces(file, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of a range, or of all from a place on."""
    file.seek(start)
    while stop is None or start < stop:
        raw = file.read(PIECE if stop is None else min(PIECE, stop - start))
        if not raw:
            return
        yield start, raw
        start += len(raw)


def low_signs(file, start: int, stop: int | None, state: int, depth: int) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(place, bytes, signs) by piece: (place in the piece, sign, depth after it) of those that leave a depth
    of two or less, and an opening bracket that leaves three is not among them."""
    for at, raw in pieces(file, start, stop):
        data = np.frombuffer(raw, np.uint8)
        places, state = signs(data, state)
        after = depth + np.cumsum(_STEP[data[places]])
        depth = int(after[-1]) if len(after) else depth
        low = after <= 2
        yield at, raw, list(zip(places[low].tolist(), data[places[low]].tolist(), after[low].tolist(), strict=True))


# first scan: states and depths


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range does to each state that it may begin in: the state and the change of depth at its end."""
    for batch in batches:
        rows = []
        for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            store, name = opened(path)
            now, steps = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
            with store.open_input_file(name) as file:
                for _, raw in pieces(file, start, stop):
                    data = np.frombuffer(raw, np.uint8)
                    found = {s: signs(data, s) for s in set(now)}
                    steps = [n + int(_STEP[data[found[s][0]]].sum()) for n, s in zip(steps, now, strict=True)]
                    now = [found[s][1] for s in now]
            rows.append((path, start, stop, *now, *steps))
        names = ["path", "start", "stop", "s0", "s1", "s2", "d0", "d1", "d2"]
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def _begun(c: Columns) -> tuple:
    """State and depth at the begin of each range of one document."""
    state, depth, states, depths = OUTSIDE, 0, [], []
    for i in range(len(c["start"])):
        states.append(state)
        depths.append(depth)
        depth += int(c[f"d{state}"][i])
        state = int(c[f"s{state}"][i])
    if state != OUTSIDE or depth:
        raise ValueError(f"{c['path'][0]} ends within a text or before its brackets are closed")
    return c["path"], c["start"], c["stop"], np.array(states), np.array(depths)


# second scan: members and numbers of elements


def _next_byte(file, at: int) -> int:
    """The next byte from a place on that is not white space, or -1."""
    for _, raw in pieces(file, at, None):
        rest = raw.lstrip(_SPACE)
        if rest:
            return rest[0]
    return -1


def _name_before(file, colon: int) -> str:
    """The text that ends before a colon."""
    size = 256
    while True:
        start = max(0, colon - size)
        file.seek(start)
        raw = file.read(colon - start).rstrip(_SPACE)
        at = len(raw) - 1
        if raw and raw[at] != QUOTE:
            break
        while (at := raw.rfind(b'"', 0, max(0, at))) >= 0:
            slashes = at - len(raw[:at].rstrip(b"\\"))
            if slashes == at and start:
                break  # more of them may stand before
            if slashes % 2 == 0:
                before = raw[:at].rstrip(_SPACE)
                if not before and start:
                    break
                if before[-1:] not in (b",", b"{"):
                    raise ValueError(f"a comma is missing before the member at byte {colon}")
                return json.loads(raw[at:])
        if not start:
            break
        size *= 4
    raise ValueError(f"the member at byte {colon} has no name")


def _blank(raw: bytes, path: str) -> None:
    if raw.strip(_SPACE):
        raise ValueError(f"{path}: an annotation document must be one JSON object, without anything before or after it")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Colons and commas of the outer object, members with name and first byte of their value, and how
    many elements of arrays in the outer object begin between them (kind ``count``, at the colon before
    them in the range, or at the range's start)."""
    for batch in batches:
        rows: list[tuple] = []
        for path, start, stop, state, depth in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            store, name = opened(path)
            with store.open_input_file(name) as file, store.open_input_file(name) as ahead:
                if start == 0 and _next_byte(ahead, 0) != ord("{"):
                    raise ValueError("an annotation document must be one JSON object")
                member, elements, level = start, 0, depth
                for at, raw, found in low_signs(file, start, stop, state, depth):
                    last = 0
                    for place, sign, after in found:
                        where = at + place
                        if level == 0:
                            _blank(raw[last:place], path)
                            if sign != OPEN:
                                raise ValueError(f"{path}: an annotation document must be one JSON object")
                            rows.append((path, start, "object", where, None, 0, 0))
                        level, last = after, place + 1
                        if after == 1 and sign == COLON:
                            rows.append((path, start, "count", member, None, 0, elements))
                            rows.append((path, start, "member", where, _name_before(ahead, where), _next_byte(ahead, where + 1), 0))
                            member, elements = where, 0
                        elif after == 1 and sign == COMMA:
                            rows.append((path, start, "comma", where, None, 0, 0))
                        elif after == 1 and sign in (END, CLOSE) and _next_byte(ahead, where + 1) not in (COMMA, CLOSE):
                            raise ValueError(f"{path}: a comma is missing after byte {where}")
                        elif after == 2 and (sign == COMMA or sign == BRACKET and _next_byte(ahead, where + 1) != END):
                            elements += 1
                    if level == 0:
                        _blank(raw[last:], path)
                rows.append((path, start, "count", member, None, 0, elements))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "kind", "place", "name", "opens", "n"])


# parsing


def elements(file, start: int, stop: int, state: int, depth: int, members: list[dict]) -> Iterator[tuple[dict, list[Any]]]:
    """(member, elements in order) of the arrays in the outer object, for elements that begin in a range: those
    after a bracket or comma there."""
    arrays = [m for m in members if m["opens"] == BRACKET]
    places = [m["place"] for m in arrays]

    def member(at: int) -> dict | None:
        i = bisect_right(places, at) - 1
        return arrays[i] if i >= 0 and at < arrays[i]["until"] else None

    held: list[bytes] | None = None
    of: dict | None = None
    for at, raw, found in low_signs(file, start, None, state, depth):
        begin = 0
        batch: list[bytes] = []
        for place, sign, after in found:
            comma, opening, closing = after == 2 and sign == COMMA, after == 2 and sign == BRACKET, after == 1 and sign == END
            if not (comma or opening or closing):
                continue
            if held is not None:
                held.append(raw[begin:place])
                text = b"".join(held)
                if text.strip(_SPACE) or not closing or of["seen"]:
                    batch.append(text)
                of["seen"] = of["seen"] or comma
                held = None
            if closing and batch:
                yield of, json.loads(b"[" + b",".join(batch) + b"]")
                batch = []
            if at + place >= stop:
                if batch:
                    yield of, json.loads(b"[" + b",".join(batch) + b"]")
                return
            if comma or opening:
                of = member(at + place)
                if of is not None:
                    of.setdefault("seen", comma)  # after a comma there must be an element
                    of["seen"] |= comma
                    held, begin = [], place + 1
        if batch:
            yield of, json.loads(b"[" + b",".join(batch) + b"]")
        if held is not None:
            held.append(raw[begin:])
        elif at + len(raw) >= stop:
            return


def parsed(rows: Callable, schema: pa.Schema) -> Callable:
    """A step that maps ranges to Arrow rows by ``rows(file, other, start, stop, state, depth, members)``, which
    gets the document opened twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, state, depth, members in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                store, name = opened(path)
                held = []
                with store.open_input_file(name) as file, store.open_input_file(name) as other:
                    for row in rows(file, other, start, stop, state, depth, sorted(members or [], key=lambda m: m["place"])):
                        held.append(row)
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def split(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Ranges of the documents at a path, as (path, start, stop, state, depth, members), and their members,
    as (path, place, name, opens, until). ``members`` of a range are those with bytes in it, with the number
    of the first element that begins in the range."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read
    empty = files.filter("length = 0").select("path").limit(1).collect()
    if empty:
        raise ValueError(f"{empty[0].path}: an annotation document must be one JSON object")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("stop"))
    tasks = max(1, ranges.count())
    effects = ranges.repartition(tasks, "path", "start").mapInArrow(_effects, "path string, start long, stop long, s0 long, s1 long, s2 long, d0 long, d1 long, d2 long")
    begun = kept(over_groups(effects, ["path"], ["start"], _begun, "path string, start long, stop long, state long, depth long"), "begun")
    marks = begun.repartition(tasks, "path", "start").mapInArrow(_marks, "path string, start long, kind string, place long, name string, opens int, n long")
    marks = kept(marks, "marks")
    order = Window.partitionBy("path").orderBy("place")
    outer = marks.filter("kind <> 'count'").select("*", F.lag("kind").over(order).alias("before"), F.lead("kind").over(order).alias("after"))
    # an object, then members with commas between them
    right = F.when(F.col("kind") == "object", F.col("before").isNull()).when(F.col("kind") == "member", F.col("before") != "member").otherwise((F.col("before") == "member") & (F.col("after") == "member"))
    broken = outer.filter(~F.coalesce(right, F.lit(False))).select("path", "place").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0].path}: a name, a value or a comma is missing around byte {broken[0].place}")
    without = begun.select("path").distinct().join(marks.filter("kind = 'object'").select("path"), "path", "left_anti").limit(1).collect()
    if without:
        raise ValueError(f"{without[0].path}: an annotation document must be one JSON object")
    members = marks.filter("kind = 'member'").select("path", "place", "name", "opens", F.coalesce(F.lead("place").over(order), F.lit(1 << 62)).alias("until"))
    # a count at a range's start belongs to the member that began before the range
    counts = marks.filter("kind = 'count'").select("path", "start", F.col("place").alias("at"), "n")
    owned = counts.join(members, "path").filter((F.col("place") <= F.col("at")) & (F.col("at") < F.col("until")))
    run = Window.partitionBy("path", "place").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = owned.groupBy("path", "place", "start").agg(F.sum("n").alias("n")).select("path", "place", "start", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("first"))
    inside = begun.join(members, "path").filter((F.col("place") < F.col("stop")) & (F.col("until") > F.col("start")))
    inside = inside.join(first, ["path", "place", "start"], "left").groupBy("path", "start")
    listed = inside.agg(F.collect_list(F.struct("place", "until", "name", "opens", F.coalesce("first", F.lit(0)).alias("first"))).alias("members"))
    found = begun.join(listed, ["path", "start"], "left").select("path", "start", "stop", "state", "depth", "members")
    return found.repartition(tasks, "path", "start"), members

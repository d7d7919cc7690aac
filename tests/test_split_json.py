"""Documents cut into ranges against the streamed reader."""

import io
import json
import random
from collections import Counter

import numpy as np
import pytest

from trackmill.sources import split_json as J
from trackmill.sources.annotations import SECTIONS, JsonStream, read_document, records


def plain_signs(raw, state):
    """Sign by sign; a backslash counts inside texts only."""
    out = []
    for i, c in enumerate(raw):
        if state == J.ESCAPED:
            state = J.INSIDE
        elif state == J.INSIDE:
            state = {ord('"'): J.OUTSIDE, ord("\\"): J.ESCAPED}.get(c, J.INSIDE)
        elif c == ord('"'):
            state = J.INSIDE
        elif c in b"{}[],:":
            out.append(i)
    return out, state


def test_states_after_any_cut():
    rng = random.Random(2)
    text = json.dumps([{rng.choice(['a', 'q"\\', '\\\\"', "é漢{", "},["]) * rng.randrange(3): rng.choice(['\\', '"', '\\"\\', "]}", 1, None, [], {}])} for _ in range(60)], ensure_ascii=False).encode()
    for _ in range(300):
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.choice([0, 1, 2, 5, 40, 400]))
        _, state = plain_signs(text[:a], J.OUTSIDE)
        places, end = J.signs(np.frombuffer(text[a:b], np.uint8), state)
        assert (places.tolist(), end) == plain_signs(text[a:b], state)


def document(seed, n=40):
    rng = random.Random(seed)
    odd = ['q"', "\\", '\\"', "}", "]", "{", "[", ",", ":", "é", "漢", "😀", "\n", '"}],"images":[{', "x" * 50]
    def obj(i):
        r = {"id": rng.choice([i, str(i)]), "name": "".join(rng.choice(odd) for _ in range(rng.randrange(6)))}
        if rng.random() < 0.4:
            r["bbox"] = [rng.choice([1, 2.5, float("nan"), 1e400]) for _ in range(4)]
        if rng.random() < 0.3:
            r["deep"] = {"annotations": [[{"id": 1}], "]"], odd[i % len(odd)]: [1, [2, {}]]}
        return r
    doc = {}
    members = [*SECTIONS, "info", "extra", 'odd "name\\', "empty"]
    rng.shuffle(members)
    for m in members[: rng.randrange(3, len(members) + 1)]:
        doc[m] = {"info": {"note": "a, b: {", "n": float("inf")}, "empty": []}.get(m, [rng.choice([obj(i), obj(i), obj(i), 7, None, "s", [1, float("nan")]]) if rng.random() < 0.1 else obj(i) for i in range(rng.randrange(n))])
        if rng.random() < 0.1:
            doc[m] = rng.choice([5, "text, with: {signs", {"a": [1, 2]}, None, float("nan")])
    return json.dumps(doc, ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")])).encode()


def counted(rows):
    """Rows as texts without nulls and false; numbers that are not finite are added up."""
    out, bad = Counter(), 0
    for r in rows:
        if r.get("name") == "nonfinite_numeric" and r["section"] == "$issue":
            bad += r["n"]
        else:
            out[json.dumps({k: v for k, v in r.items() if v is not None and v is not False}, sort_keys=True)] += 1
    return out, bad


@pytest.mark.parametrize("size, piece", [(500, 1 << 20), (1 << 20, 100)])
def test_ranges_give_the_rows_of_the_streamed_reader(spark, tmp_path, size, piece, monkeypatch):
    monkeypatch.setattr(J, "PIECE", piece)
    want = []
    for seed in range(4):
        raw = document(seed * 10 + size % 7)
        (tmp_path / f"{seed}.json").write_bytes(b" \n" * (seed * 40) + raw + b"\n " * seed * 50)
        want += records(io.BytesIO(raw))
    assert counted(r.asDict() for r in read_document(spark, str(tmp_path), size).collect()) == counted(want)


def test_pieces_and_ranges_without_spark(tmp_path):
    """The same over every small size of range and piece, by the steps themselves."""
    raw = document(3, 12)
    path = tmp_path / "d.json"
    path.write_bytes(raw)
    want = [r["id"] for r in records(io.BytesIO(raw)) if r["section"] == "annotations"]
    held = J.PIECE
    try:
        for size, J.PIECE in [(7, 5), (50, 3), (64, 64), (200, 1), (10**6, 11)]:
            got, state, depth = [], J.OUTSIDE, 0
            members = []
            with path.open("rb") as file, path.open("rb") as ahead:
                for _, chunk, low in J.low_signs(file, 0, None, J.OUTSIDE, 0):
                    at = file.tell() - len(chunk)
                    members += [{"place": at + p, "name": J._name_before(ahead, at + p), "opens": J._next_byte(ahead, at + p + 1)} for p, sign, after in low if after == 1 and sign == J.COLON]
                for m, n in zip(members, [*members[1:], {"place": 1 << 60}], strict=True):
                    m["until"] = n["place"]
                for start in range(0, len(raw), size):
                    ours = [dict(m) for m in members]
                    for m, values in J.elements(file, start, min(start + size, len(raw)), state, depth, ours):
                        if m["name"] == "annotations":
                            got += values
                    data = np.frombuffer(raw[start : start + size], np.uint8)
                    places, state = J.signs(data, state)
                    depth += int(J._STEP[data[places]].sum())
            assert [r["id"] for r in got if isinstance(r, dict)] == [int(i[2:]) if i.startswith("i:") else i[2:] for i in want]
    finally:
        J.PIECE = held


BROKEN = [b"[]", b"  ", b'{"videos": [1 2]}', b'{"videos": []} x', b'{"videos": []}{}', b'{"videos": [', b"{1: 2}", b'{"a": "x}', b'{"a": [1,]}', b'{"a": [,1]}', b'{"a": [] "b": 1}', b'{"a" "b": 1}', b'{"a": 1,}', b'{,"a": 1}', b'{"a": 1 2}', b'{"a": [1] 2, "b": 1}', b'{"a": nul}', b"7", b'{"a": [1]]}']


@pytest.mark.parametrize("raw", BROKEN)
def test_broken_documents_are_refused(spark, tmp_path, raw):
    with pytest.raises(ValueError):
        list(records(io.BytesIO(raw)))
    (tmp_path / "d.json").write_bytes(raw)
    with pytest.raises(Exception, match="."):
        read_document(spark, str(tmp_path / "d.json"), 6).collect()


def test_tasks_share_one_large_document(spark, tmp_path):
    rows = [{"id": i, "image_id": i % 97, "bbox": [1.0, 2.0, 3.0, 4.0], "name": 'a "quoted" } name'} for i in range(30_000)]
    path = tmp_path / "d.json"
    path.write_text(json.dumps({s: rows if s == "annotations" else [] for s in SECTIONS}))
    size = path.stat().st_size // 40
    ranges, members = J.split(spark, str(path), size)
    assert ranges.count() in (40, 41) and members.count() == 5
    got = read_document(spark, str(path), size)
    assert got.selectExpr("count(*)", "count(distinct ord)", "max(ord)", "count(distinct id)").first() == (30_000, 30_000, 29_999, 30_000)
    assert got.rdd.getNumPartitions() >= 40
    assert JsonStream.CHUNK == 1 << 20

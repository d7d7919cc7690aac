import hashlib
import math
from collections import Counter

import numpy as np
import xxhash

from trackmill.llm import feature_digest as D


def brute_level(window):
    h = sum(c * math.log2(c) for c in Counter(window).values())
    return (64 * 6 - h) / (64 * 6) * D.LEVELS


def test_levels_follow_the_definition():
    rng = np.random.default_rng(0)
    data = np.r_[rng.integers(0, 256, 300), np.zeros(100, int), rng.integers(97, 101, 300)].astype(np.uint8)
    got = D.entropy_levels(data)
    want = [brute_level(data[i : i + 64].tolist()) for i in range(len(data) - 63)]
    assert len(got) == len(want) and np.abs(got - np.array(want)).max() <= 1.01


def brute_features(raw, rank):
    data = np.frombuffer(raw, np.uint8)
    if not raw:
        return []
    level = D.entropy_levels(data)
    r = [int(rank[0][v]) for v in level]
    votes = Counter()
    for i in range(len(r)):
        j = min(range(i, min(i + 64, len(r))), key=lambda x: (r[x], x))
        if r[j] < D.NO_RANK:
            votes[j] += 1
    return [j for j in sorted(votes) if votes[j] >= D.POPULAR]


def brute_short(raw, rank):
    """The hashes of the rarest windows of eight bytes, sorted by rank of entropy, then hash."""
    found = set()
    for i in range(len(raw) - 7):
        h = sum(int(D._COUNT_LOG[c]) for c in Counter(raw[i : i + 8]).values())
        level = (int(D._COUNT_LOG[8]) - h) * D.LEVELS // int(D._COUNT_LOG[8])
        if rank[1][level] < D.NO_RANK:
            found.add((int(rank[1][level]), int(D._mixed(np.frombuffer(raw[i : i + 8], np.uint64)[None])[0])))
    return [h for _, h in sorted(found)[: D.SHORT_FEATURES]]


def signed(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    out = []
    for (d, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        q = len(t) // 4
        e = t[: len(t) - q] + f[:q]
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, f))
    return out


def check(df, rows_a_bucket=4000):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = D.digest_table(df, rows_a_bucket).collect()
    want = brute_rows(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(w[:3] for w in want)
    digester = D.Digester(D.ranks(D.histogram(df)))
    one = lambda t: digester.digests(t.encode(), np.array([0, len(t.encode())]))[0]
    expected = sorted((w[0], w[2], D.as_text(one(w[3])), D.as_text(one(w[4])), D.likeness(one(w[3]), one(w[4])), D.likeness(one(w[3]), one(w[5]))) for w in want)
    assert sorted((str(r.doc_id), r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == expected
    return got


def test_real_rows_match_brute_force(real_docs):
    got = check(real_docs)
    for rows in (1, 7, 60):
        assert sorted(D.digest_table(real_docs, rows).collect()) == sorted(got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.4


def test_edge_rows(edge_docs, no_docs, spark):
    check(edge_docs)
    check(edge_docs, 2)
    assert D.digest_table(no_docs).collect() == []
    check(spark.createDataFrame([(5, "the only row " * 20)], "doc_id long, text string"))


def test_features_follow_the_definition(real_docs):
    rank = D.ranks(D.histogram(real_docs))
    digester = D.Digester(rank)
    texts = [r.text.encode() for r in real_docs.limit(12).collect()]
    offsets = np.cumsum([0, *map(len, texts)])
    texts += [t[:n] for t in texts for n in (9, 60, 100, 250, 256, 260)] + [b"ab" * 500, b"abcdefgh" * 40 + b"x"]
    offsets = np.cumsum([0, *map(len, texts)])
    for raw, got in zip(texts, digester.features(b"".join(texts), offsets), strict=True):
        hashes = [int(D._mixed(np.frombuffer(raw[p : p + 64], np.uint64)[None])[0]) for p in brute_features(raw, rank)] + brute_short(raw, rank)
        assert len(hashes) and got.tolist() == list(dict.fromkeys(hashes))


def test_histogram_counts_all_windows(real_docs):
    want = np.zeros((2, D.LEVELS + 1), np.int64)
    for r in real_docs.collect():
        for i, n in enumerate((64, 8)):
            want[i] += np.bincount(D.entropy_levels(np.frombuffer(r.text.encode(), np.uint8), n), minlength=D.LEVELS + 1)
    assert (D.histogram(real_docs) == want).all()


def test_likeness_bounds_and_symmetry():
    rng = np.random.default_rng(1)
    a, b = (D.chain(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (500, 120))
    assert D.likeness(a, a) == 1 and D.likeness(a, b) == D.likeness(b, a) < 0.15
    none = D.chain(np.zeros(0, np.uint64))
    assert D.likeness(none, none) == 1 and D.likeness(none, a) == 0


def test_short_texts_are_like_their_edits(spark):
    rows = [(i, f"a short line number {i * 7919} of some {i} words that ends soon"[: 12 + 4 * i]) for i in range(12)]
    got = D.digest_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.near_edited > 0.3 for r in got if r.n_chars >= 24)


def test_likeness_does_not_break_off_at_any_length(real_docs):
    """Texts of nearly one length, and their edits, are about equally alike, whatever the length."""
    digester = D.Digester(D.ranks(D.histogram(real_docs)))
    texts = [r.text for r in real_docs.filter("length(text) > 1200").limit(60).collect()]
    mean = {}
    for n in (60, 90, 128, 200, 250, 256, 262, 320, 600, 1100):
        pairs = [(t[:n], t[: n - n // 4] + u[: n // 4]) for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
        one = lambda t: digester.digests(t.encode(), np.array([0, len(t.encode())]))[0]
        mean[n] = np.mean([D.likeness(one(a), one(b)) for a, b in pairs])
    assert min(mean.values()) > 0.55, mean
    steps = [abs(mean[a] - mean[b]) for a, b in ((250, 256), (256, 262), (128, 200), (60, 90))]
    assert max(steps) < 0.1, mean
    print(mean)


def test_many_rows_of_one_id_and_copies(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_ROWS", 3)
    monkeypatch.setattr(D, "OUT_ROWS", 4)
    rows = [(None, f"text without an id {i % 9} " * 9) for i in range(40)] + [(7, f"text of seven {i} " * 5) for i in range(40)]
    rows += [(3, "the same row " * 20)] * 30 + [(4, None)] * 5 + [(9, "the last row " * 9)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (None, 1, 16):
        check(d, size)


def test_text_ids_and_odd_columns(spark):
    rows = [(k, f"text of {k} " * 12, 1, 2, 3) for k in ("b", "a", "", "é", "10", "9")] + [(None, "no id " * 30, 1, 2, 3)]
    d = spark.createDataFrame(rows, "doc_id string, text string, `my col` int, `a-b` int, `a.b` int")
    got = D.digest_table(d, 2)
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    want = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        q = len(a[1]) // 4
        want.append((a[0], hashlib.sha256((a[1][: len(a[1]) - q] + b[1][:q]).encode()).hexdigest()))
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted(((r.doc_id, r.edited_sha256) for r in got.collect()), key=str) == sorted(want, key=str)

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from trackmill.llm import near_texts as N


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])


def plain_pairs(sets, least=0.8):
    """All pairs of distinct sets with that similarity, by the shingles that they share."""
    by, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for members in by.values():
        for a, i in enumerate(members):
            for j in members[a + 1 :]:
                shared[i, j] += 1
    return [(i, j) for (i, j), n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)]


def plain_groups(rows, least=0.8):
    """rows (key, text) -> the smallest key that each row reaches over all pairs."""
    sets = list({shingles(t): None for _, t in rows})
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in plain_pairs(sets, least):
        parent[top(i)] = top(j)
    place = {s: i for i, s in enumerate(sets)}
    least_of = {}
    for k, t in rows:
        g = top(place[shingles(t)])
        if k is not None:
            least_of[g] = min(k, least_of.get(g, k))
    return sorted((str(k), least_of.get(top(place[shingles(t)]))) for k, t in rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed, n=60):
    """Texts with copies, lightly and heavily edited ones, and a long passage that many share."""
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    passage, out = make(40), []
    for _ in range(n):
        words = make(rng.choice([3, 8, 30, 90, 300]))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            out.append(" ".join(edited(rng, words, rng.choice([0, 1, 1, 2, len(words) // 10]))))
        out.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        out.append(" ".join([*make(rng.choice([6, 12, 30])), *passage]))
    rng.shuffle(out)
    return out


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(4)


def test_signatures_follow_the_definition():
    text = "Some words of a text that is longer than five words\tand holds some words of a text twice"
    parts = list(N.shingle_parts(text.encode()))
    hashes = [xxhash.xxh64_intdigest(" ".join(text.lower().split()[i : i + 5]), 42) for i in range(len(text.split()) - 4)]
    assert np.concatenate(parts).tolist() == hashes
    fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert N.fingerprint(parts) % (1 << 64) == fp
    held = N.PART
    try:
        N.PART = 3
        assert np.concatenate(list(N.shingle_parts(text.encode()))).tolist() == hashes and N.fingerprint(list(N.shingle_parts(text.encode()))) == N.fingerprint(parts)
    finally:
        N.PART = held
    assert list(N.shingle_parts(b" ")) == [] and len(next(N.shingle_parts(b"A b"))) == 1


def test_bands_meet_as_often_as_they_should():
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(300):
        common, own = rng.integers(0, 1 << 62, 400).astype(np.uint64), rng.integers(0, 1 << 62, 100).astype(np.uint64)
        met += any(a == b for a, b in zip(N.bands(np.r_[common, own[:50]]), N.bands(np.r_[common, own[50:]]), strict=True))  # similarity 0.8
    assert met >= 0.97 * 300


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed)))
    got = sorted((str(r.key), r.component) for r in N.near_groups(frame(spark, rows)).collect())
    assert got == plain_groups(rows)


def test_recall_over_the_table(spark, sf):
    """Of the pairs of different texts that share four fifths of their shingles, those in one group."""
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    group = {r.key: r.component for r in N.near_groups(docs).collect()}
    by_text = {shingles(t): k for k, t in rows}
    sets = list(by_text)
    pairs = plain_pairs(sets)
    met = sum(group[by_text[sets[i]]] == group[by_text[sets[j]]] for i, j in pairs)
    assert pairs and met >= 0.9 * len(pairs)
    assert sorted((str(k), c) for k, c in group.items()) == plain_groups(rows)


def test_one_row_of_each_group_stays(spark, edge_texts):
    texts = corpus(3, 15) + edge_texts
    rows = [(i // 2 if i % 7 else None, t, len(t or ""), "x", [i]) for i, t in enumerate(texts)] + [(5, "the only text of its kind, twice in the table", 1, "y", None)] * 2
    docs = frame(spark, rows, "doc_id long, text string, n_chars long, `a.b` string, file array<int>")
    out = N.keep_one(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    kept = [tuple(r) for r in out.collect()]
    sets = list({shingles(r[1]): None for r in rows})
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in plain_pairs(sets):
        parent[top(i)] = top(j)
    place = {s: i for i, s in enumerate(sets)}
    first = {}
    for r in rows:
        g = top(place[shingles(r[1])])
        first[g] = min(first.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((top(place[shingles(r[1])]), (r[0] is None, r[0] or 0)) for r in kept) == sorted(first.items())
    assert all(any(tuple(r) == k for r in rows) for k in kept)
    again = N.keep_one(out)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert N.keep_one(docs.limit(0)).collect() == []


def test_a_hub_joins_copies_that_are_not_alike(spark):
    """Edits of one text that are like it, but not like each other."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = [(50, " ".join(words))] + [(i, " ".join(edited(rng, words, 4))) for i in range(100) if i != 50]
    got = {r.component for r in N.near_groups(frame(spark, rows)).collect()}
    assert got == {c for _, c in plain_groups(rows)} == {0}


def test_texts_with_a_common_passage_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Most of each text is the passage, which is too little to be alike; some have a near copy."""
    rng = random.Random(9)
    make = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage = make(60)
    words = [[*make(rng.choice([9, 12, 15])), *passage, *make(6)] for _ in range(150)]
    words += [[*w[:-1], "other"] for w in words[::15]]
    compared, alike = [], N._alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(N, "_alike", counted)
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    got = sorted((str(r.key), r.component) for r in N.near_groups(frame(spark, rows)).collect())
    assert got == plain_groups(rows) and len({c for _, c in got}) == 150
    assert sum(compared) <= 2 * len(rows)


def test_parities_never_show_more_than_the_sets_differ_in():
    rng = np.random.default_rng(1)
    for n, m in ((0, 3), (5, 1), (150, 20), (3000, 400)):
        common, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, m, m // 2))
        one, other = N.parities(np.r_[common, a]), N.parities(np.r_[common, b])
        assert len(one) == N.SKETCH // 64 and np.bitwise_count((one ^ other).view(np.uint64)).sum() <= m + m // 2

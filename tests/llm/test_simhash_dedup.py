import random
import re

import numpy as np
import xxhash

from trackmill.llm import simhash_dedup as S


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fp); the smallest doc_id reachable over all pairs."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), f"{fp:016x}", least.get(top(i))) for i, (d, fp) in enumerate(rows))


def found(df):
    return sorted((str(r[0]), r[1], r[2]) for r in S.dedup_table(df).collect())


def test_edge_rows_match_brute_force(edge_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in edge_docs.collect()]
    assert found(edge_docs) == plain_components(rows)


def test_real_rows_match_brute_force(real_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in real_docs.collect()]
    assert found(real_docs) == plain_components(rows)


def test_empty_table(no_docs):
    assert found(no_docs) == []


def near_prints(n, seed=5):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {0}
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_groups_of_dense_clusters_with_small_shards(spark):
    prints = near_prints(600)
    rows = list(enumerate(prints))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    for limit in (100_000, 20):
        entries = S.shard_entries(df, limit=limit)
        star = {r.node: r.root for r in S.connected(S.shard_links(entries)).collect()}
        got = {}
        for i, x in rows:
            x = x - (1 << 64) if x >> 63 else x
            got.setdefault(star.get(x, x), set()).add(i)
        want = {}
        for d, _, c in plain_components(rows):
            want.setdefault(c, set()).add(int(d))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_forest_matches_all_pairs():
    prints = np.array(near_prints(400, 9), np.uint64)
    shard = np.sort(np.random.default_rng(1).integers(0, 5, len(prints)))
    lab = S.Forest(shard, prints).groups(3)
    gap = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    a, b = np.nonzero(gap & (shard[:, None] == shard[None, :]))
    assert (lab == S.components(len(prints), a, b)).all()

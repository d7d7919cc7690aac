import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb

from trackmill.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def sql_rest(c):
    return c - (abs(c) % 20) * (1 if c >= 0 else -1)


def plain_trie(rows):
    """rows (conv_id, turn, role, text) -> the nodes, straight from the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(pair[0].encode())}:{pair[0]}{pair[1]}".encode()).digest(), pair))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(set)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(sql_rest(c), [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].add(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c in convs if full[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, T.trie_table(df).collect()), key=str)


def test_random_tries_match_the_definition(spark):
    rng = random.Random(5)
    texts = ["a b", "a  b", "", None, "c\td e", "é ü", "x" * 3000, "long " * 2000]
    rows = []
    for c in [*range(-45, 130, rng.choice([1, 2])), 4099, 4100, 8200]:
        start = rng.randrange(3)
        for turn in range(rng.randrange(0, 7)):
            rows.append((c, rng.choice([turn, turn, None]) if rng.random() < 0.2 else turn, rng.choice(["user", "user", None, ""]), texts[(start + turn) % 3] if rng.random() < 0.7 else rng.choice(texts)))
    rows += rows[:40] + [(None, 0, "user", "no conversation")] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == plain_trie(rows)


def test_copies_chains_and_turnless_conversations(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(3)]
    deep = [(c, t, "user", f"word {t}") for c in (40001, 40002) for t in range(300)]
    single = [(c, 0, "user", "only") for c in range(70001, 70015)]  # those that want shared turns of an absent one have none
    rows = copies + deep + single
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got == plain_trie(rows)
    assert any(depth == 0 and ends != T.NO_ENDS for _, depth, *_, ends in got)


def test_long_lists_of_ends_come_in_pieces(spark):
    ids = list(range(-9000, 9000, 20))
    got = found(spark.createDataFrame([(c, 0, "u", "t") for c in ids], SCHEMA).repartition(3))
    ends = [c for c in ids if True]
    leaf = next(r for r in got if r[1] == 1)
    assert leaf[7] == hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() and leaf[3] == len(ids)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, 0, "user", "hi", "d", 9, [1]), (1, 1, None, None, None, None, None), (2, None, "user", "hi", "x", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", digest string, depth int, base array<int>")
    assert found(df) == plain_trie([r[:4] for r in rows])


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    out = T.trie_table(spark.read.parquet(f"{sf}/conversations.parquet"))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({T.ORACLE})").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert all(kind == "bigint" for name, kind in out.dtypes if name != "ends_sha256")

import hashlib
import random
import re

import numpy as np

from trackmill.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for i in range(len(w)):
            for m in sizes:
                if i + m <= len(w) and (found := windows.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    items |= found
        names = sorted(str(i) for i in items if i is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def got(docs, bench):
    return sorted((str(r[0]), *r[1:]) for r in D.contamination_table(docs, bench).collect())


def test_real_rows(spark, sf, real_docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in real_docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(real_docs, bench) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def made_case():
    rng = random.Random(8)
    vocab = ["a", "b", "The", "é", "x9", "zz", "q"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(1, text(30)), (2, text(13)), (3, "b é b"), (4, "rare"), (5, ""), (6, None), (None, "only unnamed words here"), (7, text(5)), (7, "second text of seven")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(100, bench[0][1] + " and " + bench[0][1]), (101, "rare"), (102, None), (103, ""), (104, "x " * 400 + bench[1][1]), (None, "Only, unnamed WORDS here"), (101, "rare")]
    return docs, bench


def test_made_rows_in_one_and_many_blocks(spark, monkeypatch):
    docs, bench = made_case()
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame([(*r, "c") for r in bench], "item_id long, text string, key string")
    want = brute(docs, bench)
    assert got(d, b) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    assert got(d, b) == want


def test_edge_rows_and_empty_tables(spark, edge_docs, no_docs):
    b = spark.createDataFrame([(1, "same text"), (2, "nul")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert got(edge_docs, b) == brute(rows, [(1, "same text"), (2, "nul")])
    assert got(no_docs, b) == []
    assert all(not r[5] for r in got(edge_docs, b.limit(0)))


def test_spans_cover_the_passage(spark):
    passage = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn"
    d = spark.createDataFrame([(1, f"Ä vor, {passage.upper().replace('Ü', 'ü').replace('Ö', 'ö')}! nach")], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    (row,) = D.contamination(d, b).collect()
    text = d.collect()[0].text
    assert text[row.spans[0] : row.spans[1]].lower() == passage and len(row.spans) == 2


def test_drop_keeps_clean_rows_whole(spark):
    docs, bench = made_case()
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    bad = {r[0] for r in brute(docs, bench) if r[5]}
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad)


def test_index_against_scan():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 4, 3000)
    seq[-1] = 0
    index = D.FMIndex(seq, 4)
    for m in (1, 2, 3, 5, 7):
        patterns = rng.integers(1, 4, (40, m))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(seq) - m + 1) if (seq[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want

import zlib

import numpy as np
import pytest

from trackmill.llm import quality_fm as Q


@pytest.fixture(scope="module")
def tables(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return Q.fit(*tables)


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = Q.quality_table(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_linear_time_score_equals_all_pairs(model):
    texts, declared = [b"a few words and Some MORE words", b"", b"x | y | z ### 12"], np.array([31.0, np.nan, 2.0])
    f = Q.Features(texts, declared)
    for i, text in enumerate(texts):
        x = np.zeros(len(model.w))
        np.add.at(x, f.column[f.row == i], f.weight[f.row == i])
        x[model.bins(f.statistics)[i]] = 1
        on = np.flatnonzero(x)
        margin = model.w0 + model.w @ x + sum(model.v[a] @ model.v[b] * x[a] * x[b] for k, a in enumerate(on) for b in on[:k])
        assert np.isclose(model.score([text], declared[i : i + 1])[0], 1 / (1 + np.exp(-margin)))


def test_held_out_labels_are_not_read(tables):
    docs, labels = tables
    held = Q.fold("doc_id", Q.FOLDS) == Q.HELD_OUT
    flipped = labels.withColumn("quality", Q.F.when(held, 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, flipped)
    assert (a.w == b.w).all() and (a.v == b.v).all()


def test_score_does_not_depend_on_the_batch(tables, model):
    rows = tables[0].limit(150).collect()
    texts, declared = [r.text.encode() for r in rows], np.array([r.n_chars for r in rows], float)
    together = model.score(texts, declared)
    assert np.allclose(together, [model.score([t], declared[i : i + 1])[0] for i, t in enumerate(texts)])


def test_edge_rows_and_degenerate_labels(spark, tables, model, edge_docs, no_docs):
    rows = Q.scored(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    no_length = edge_docs.withColumn("n_chars", Q.F.lit(None).cast("long"))
    assert all(0 <= r.score <= 1 for r in Q.scored(no_length, model).collect())
    assert Q.scored(no_docs, model).collect() == []
    assert {r.score for r in Q.quality_table(edge_docs, tables[1].limit(0)).collect()} == {0.5}


def plain_statistics(text, declared):
    """The statistics of one text, counted one by one, and the weight of each hashed word."""
    raw = text.encode()
    words = [w.lower() for w in raw.split()]
    n, size = max(len(words), 1), max(len(raw), 1)
    share = lambda test: sum(map(test, raw)) / size
    letter, digit = lambda c: 65 <= c <= 90 or 97 <= c <= 122, lambda c: 48 <= c <= 57
    lines = raw.count(b"\n") + 1
    top = max((words.count(w) for w in set(words)), default=0)
    follows = sum(a == b for a, b in zip(words, words[1:], strict=False))
    chars = len(text)
    values = [
        np.log1p(len(words)), np.log1p(len(raw)), sum(map(len, words)) / n, share(lambda c: 65 <= c <= 90), share(digit), share(lambda c: 32 < c < 128 and not letter(c) and not digit(c)),
        share(lambda c: c in b"#$%&*|<>=~^{}[]\\_/"), share(lambda c: c in b"!?"), share(lambda c: c >= 128), len(set(words)) / n, follows / n, np.log1p(lines), np.log1p(len(words) / lines), top / n,
        np.log1p(max(declared, 0)), abs(declared - chars) / max(chars, 1),
    ]
    columns = {}
    for w in words:
        c = zlib.crc32(w) & ((1 << Q.WORD_BITS) - 1)
        columns[c] = columns.get(c, 0) + 1
    norm = np.sqrt(sum(np.log1p(k) ** 2 for k in columns.values()))
    return values, {c: Q.WORD_WEIGHT * np.log1p(k) / norm for c, k in columns.items()}


def test_features_follow_the_definition(tables):
    rows = tables[0].filter("length(text) < 5000").limit(80).collect()
    texts = [r.text for r in rows] + ["", " ", "One", "a a a b\n\nc ! ? # é"]
    declared = np.array([float(r.n_chars) for r in rows] + [0.0, 7.0, -3.0, 20.0])
    f = Q.Features([t.encode() for t in texts], declared)
    for i, (t, d) in enumerate(zip(texts, declared, strict=True)):
        values, words = plain_statistics(t, d)
        assert np.allclose(f.statistics[i], values), t
        own = f.row == i
        got = dict(zip(f.column[own].tolist(), f.weight[own].tolist(), strict=True))
        assert got.keys() == words.keys() and all(np.isclose(got[c], words[c]) for c in got)


@pytest.mark.parametrize("n, good", [(2, 1), (5, 4), (29, 14), (30, 15), (29, 1)])
def test_few_labels_still_make_a_model(n, good):
    """Nothing but a missing class gives a constant."""
    texts = [(f"The harbour opened its gates at dawn, and boats came in on day {i}." if i < good else f"$$$ ### {i} &&& *** %%% $$$ ###").encode() for i in range(n)]
    label = np.array([i < good for i in range(n)], float)
    declared = np.array([float(len(t)) for t in texts])
    m = Q.FactorisationMachine(Q.Features.gathered(texts, declared), label)
    a, b = m.score([b"The boats left the harbour at noon, and its gates closed.", b"### $$$ &&& 7 %%% ***"], np.array([56.0, 21.0]))
    assert m.w is not None and a > b
    assert Q.FactorisationMachine(Q.Features.gathered(texts, declared), np.ones(n)).w is None

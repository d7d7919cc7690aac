import random
import zlib

import numpy as np
import pytest

from trackmill.llm import toxicity_gbt as T


@pytest.fixture(scope="module")
def tables(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return T.fit(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    rows = T.toxicity_table(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_labels_are_not_read(tables):
    docs, labels = tables
    held = T.fold("doc_id", T.FOLDS) == T.HELD_OUT
    flipped = labels.withColumn("toxic", T.F.when(held, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, flipped)
    texts = [r.text.encode() for r in docs.limit(300).collect()]
    assert (a.score(a.featurizer(), texts) == b.score(b.featurizer(), texts)).all()


def test_score_does_not_depend_on_the_batch(tables, model):
    texts = [r.text.encode() for r in tables[0].limit(200).collect()]
    together = model.score(model.featurizer(), texts)
    alone = model.featurizer()
    assert np.allclose(together, [model.score(alone, [t])[0] for t in texts])


def test_edge_rows_and_degenerate_labels(spark, tables, model, edge_docs, no_docs):
    assert T.scored(edge_docs, model).count() == edge_docs.count()
    assert all(r.score is not None for r in T.scored(edge_docs, model).collect())
    assert T.scored(no_docs, model).collect() == []
    none = tables[1].limit(0)
    assert {r.score for r in T.toxicity_table(edge_docs, none).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.toxicity_table(edge_docs, nulls).collect()} == {0.0}


def test_drop_keeps_clean_rows_whole(tables):
    docs, labels = tables
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    table = T.toxicity_table(docs, labels).filter("predicted = 0")
    assert kept.count() == table.count() == kept.join(docs, docs.columns, "left_semi").count()


def test_disguised_words():
    seen = T.Featurizer({"idiot": 3.0})
    x = seen.batch([b"you are an 1d10t", b"you are an i.d.i.o.t", b"idiooooot", b"you idiot", b"plain words"])
    hits = x[:, T.FEATURES.index("hits")] > 0
    assert hits.tolist() == [True, True, True, True, False]
    assert (x[:, T.FEATURES.index("near_rate")] > 0).tolist() == [True, True, False, True, False]


def test_isotonic_is_the_best_rising_fit():
    rng = random.Random(3)
    s = np.array([rng.random() for _ in range(60)])
    y = np.array([float(rng.random() < v) for v in s])
    _, p = T.isotonic(s, y)
    assert (np.diff(p) > 0).all()
    order = np.argsort(s)
    want = [max(min(y[order][a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(p, 9))


def plain_features(text, lexicon):
    """The features of one text, word by word."""
    words = text.split()  # of these texts white space is ASCII
    n, second = max(len(words), 1), set(T.SECOND_PERSON)
    def look(w):
        core = T.plain(w)
        odds = max([lexicon.get(core, 0.0), *(lexicon.get(core[:k] + "*", 0.0) for k in T.PREFIXES if len(core) > k)])
        inner = w.strip(".,;:!?\"'()[]|#$%&*")
        mangled = bool(inner) and not inner.isalpha() and any(c.isalpha() for c in inner)
        repeated = any(core[i] == core[i + 1] == core[i + 2] for i in range(len(core) - 2))
        hidden = lexicon.get(T.revealed(w), 0.0) if not odds and (mangled or repeated) else 0.0
        return odds or hidden, core in second, len(core) > 1 and inner.isupper(), mangled, hidden > 0

    seen = [look(w) for w in words]
    hits = [i for i, s in enumerate(seen) if s[0] > 0]
    near = sum(any(s[1] for s in seen[max(0, i - T.NEAR_WORDS) : i + T.NEAR_WORDS + 1]) for i in hits)
    raw = text.encode()
    size = max(len(raw), 1)
    capital = sum(65 <= c <= 90 for c in raw)
    marks = sum(c in b"!?" for c in raw)
    signs = sum(32 < c < 128 and not chr(c).isalnum() and c not in b"!?" for c in raw)
    count = lambda k: sum(s[k] for s in seen)
    return [len(hits) / n, np.log1p(len(hits)), sum(s[0] for s in seen) / n, near / n, count(1) / n, capital / size, count(2) / n, marks / size, signs / size, count(3) / n, np.log1p(count(4)), np.log1p(len(words))]


def test_features_follow_the_definition(tables, model):
    texts = [r.text for r in tables[0].filter("length(text) < 4000").limit(150).collect()]
    texts += ["", "You 1d10t, YOU stuuupid i-d-i-o-t!", "x" * 50 + "i.d.i.o.t", "A" * 60, "dumb " * 3 + "your fool?"]
    texts = [t for t in texts if t.split() == [w.decode() for w in t.encode().split()]]
    got = T.Featurizer(model.lexicon).batch([t.encode() for t in texts])
    assert len(texts) > 100 and np.allclose(got, [plain_features(t, model.lexicon) for t in texts])


def test_long_words_are_unmasked():
    x = T.Featurizer({"donaudampferkapitaensgesellschaftsidiot": 3.0}).batch([b"d0naudampferkapitaensgesellschafts-1d10t"])
    assert x[0, T.FEATURES.index("mangled_hits")] > 0


def test_trees_follow_their_nodes(model):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(0, 0.3, (200, len(T.FEATURES))))
    want = []
    for row in x:
        total = model.trees.base
        bins = [int(np.searchsorted(e, v, "left")) for e, v in zip(model.trees.edges, row, strict=True)]
        for tree in model.trees.trees:
            at = 0
            while tree["feature"][at] >= 0:
                at = 2 * at + 1 + (bins[tree["feature"][at]] > tree["cut"][at])
            total += tree["value"][at]
        want.append(total)
    assert np.allclose(model.trees.raw(x), want)


def test_splits_on_evidence_rise(model):
    """No tree takes a split in which more of a feature of toxicity has the lower value right below."""
    for tree in model.trees.trees:
        for at in np.flatnonzero(np.isin(tree["feature"], list(T.RISING))).tolist():
            if tree["feature"][2 * at + 1] < 0 and tree["feature"][2 * at + 2] < 0:
                assert tree["value"][2 * at + 1] <= tree["value"][2 * at + 2] + 1e-9


def test_held_out_recall_with_few_labels(spark, sf):
    """Every fold of the small table held out in turn."""
    d = sf.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    caught = toxic = wrong = 0
    for k in range(5):
        held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == k]
        rest = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != k]
        m = T.ToxicityModel([r.text.encode() for r in rest], np.array([float(r.toxic) for r in rest]))
        p = m.score(m.featurizer(), [r.text.encode() for r in held]) >= 0.5
        y = np.array([r.toxic for r in held]) > 0
        caught, toxic, wrong = caught + int((p & y).sum()), toxic + int(y.sum()), wrong + int((p & ~y).sum())
    assert caught >= 0.9 * toxic and wrong <= 0.01 * len(rows)


@pytest.mark.parametrize("n, toxic", [(2, 1), (3, 2), (8, 1), (16, 4), (29, 15), (29, 2), (30, 3), (400, 2), (400, 1)])
def test_few_labels_still_make_a_model(n, toxic):
    """Nothing but a missing class gives a constant, and clean texts stay clean."""
    texts = [(f"you are a stupid idiot and worthless scum number {i}" if i < toxic else f"the harbour opened its gates at dawn on day {i}").encode() for i in range(n)]
    label = np.array([i < toxic for i in range(n)], float)
    m = T.ToxicityModel(texts, label)
    bad, good = m.score(m.featurizer(), [b"you stupid idiot, worthless scum", b"the ferry left the harbour at noon"])
    assert m.trees is not None and bad > good and good < 0.5
    none = T.ToxicityModel(texts, np.zeros(n))
    assert none.trees is None and none.constant == 0


def test_labels_that_texts_do_not_explain_reject_nothing():
    texts = [b"the harbour", b"gates at dawn"] * 20
    m = T.ToxicityModel(texts, np.arange(40) // 2 % 2.0)
    assert (m.score(m.featurizer(), [*texts[:2], b""]) < 0.5).all()

import hashlib
import struct

import public_tokenizers
import pytest
from test_decontam import brute as contamination
from test_near_texts import plain_groups
from test_secret_scan import base as secret_spans
from tokenizers import Tokenizer

import corpus_pipeline as C
from trackmill.llm import toxicity_gbt


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage was given and what it returned, as rows."""
    d = sf.replace("sf0.001", "sf0.01")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in C.STAGES:
        out = C.materialize(stage(spark, docs, d), f"test-{name}")
        seen[name] = docs, out
        docs = out
    return d, seen


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    _, seen = stages
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    assert all(out.columns == given.columns for name, (given, out) in seen.items() if name != "encoding")


def test_toxicity(spark, stages):
    d, seen = stages
    given, out = seen["toxicity"]
    table = toxicity_gbt.toxicity_table(given, spark.read.parquet(f"{d}/labels.parquet"))
    assert set(rows(out)) == {r.doc_id for r in table.filter("predicted = 0").collect()}
    assert 0 < out.count() < given.count()


def test_near_duplicates(stages):
    """One document of each group of all pairs that share four fifths of their five-word shingles."""
    given, out = stages[1]["near_duplicates"]
    groups = plain_groups([(i, r.text) for i, r in rows(given).items()])
    assert sorted(rows(out)) == sorted({c for _, c in groups}) and len(rows(out)) < len(rows(given))


def test_decontamination(spark, stages):
    d, seen = stages
    given, out = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {int(r[0]) for r in contamination([(i, r.text) for i, r in rows(given).items()], bench) if not r[5]}
    assert set(rows(out)) == clean and len(clean) < given.count()


def test_secrets(stages):
    given, out = map(rows, stages[1]["secrets"])
    assert set(given) == set(out)
    for i, r in given.items():
        assert secret_spans(out[i].text)[1] == ""
        if not secret_spans(r.text)[1]:
            assert out[i] == r
        assert out[i].n_chars == len(out[i].text)


def test_encoding(stages):
    given, out = map(rows, stages[1]["encoding"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(given) == set(out)
    for i, r in given.items():
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def test_run_gives_the_last_stage(spark, stages):
    d, seen = stages
    assert sorted(C.run(spark, d).collect()) == sorted(seen["encoding"][1].collect())

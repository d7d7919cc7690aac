"""All operators and the pipeline on odd tables: strange and clashing column names, text ids, nulls, no rows."""

import public_tokenizers
import pytest

import corpus_pipeline
from trackmill.llm import bpe_codec, common, decontam, feature_digest, near_texts, pii_crf, quality_fm, secret_scan, simhash_dedup, token_counts, toxicity_gbt, warc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = "`my col` string, `a-b` int, `a.b` int, `key` string, `row` string, `score` string, `spans` array<int>, `label` string, `we``ird` int"


@pytest.fixture(scope="module", params=["long", "string"])
def tables(spark, request, edge_texts):
    """Documents, labels and a benchmark whose ids are numbers or text."""
    key = int if request.param == "long" else lambda i: f"id {i}/é"
    extra = ("m", 1, None, "k", "r", "s", [1], None, 4)
    rows = [(key(i), t, "en", "src", None if t is None else len(t), *extra) for i, t in enumerate(edge_texts)]
    rows += [(None, "text without an id, twice", "en", "src", None, *extra)] * 2 + [(key(3), "a second text of an id", "en", "src", 3, *extra)]
    docs = spark.createDataFrame(rows, f"doc_id {request.param}, text string, lang string, source string, n_chars int, {EXTRA}").repartition(3)
    labels = spark.createDataFrame([(key(i), i % 2, i % 2) for i in range(6)] + [(None, 1, 1), (key(7), None, None)], f"doc_id {request.param}, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "same text", 1), (2, None, 1), (None, "nul", 1)], "item_id int, text string, `a.b` int")
    return docs, labels, benchmark


def operators(docs, labels, benchmark):
    yield simhash_dedup.dedup_table(docs)
    yield feature_digest.digest_table(docs)
    yield feature_digest.fingerprints(docs)
    yield bpe_codec.codec_table(docs, BPE)
    yield secret_scan.secrets_table(docs)
    yield token_counts.token_counts(docs, PIECES)
    yield decontam.contamination_table(docs, benchmark)
    yield quality_fm.quality_table(docs, labels)
    yield pii_crf.pii_table(docs)
    yield toxicity_gbt.toxicity_table(docs, labels)


def test_every_row_has_a_result_and_ids_keep_their_type(tables):
    docs, ids = tables[0], sorted(str(r.doc_id) for r in tables[0].collect())
    for out in operators(*tables):
        assert out.schema[0].dataType == docs.schema["doc_id"].dataType
        assert sorted(str(r[0]) for r in out.collect()) == ids, out.columns


def test_empty_tables(tables):
    for out in operators(*(t.limit(0) for t in tables)):
        assert out.collect() == [], out.columns


def test_stages_hand_rows_on_whole(tables):
    docs, labels, benchmark = tables
    kept = [toxicity_gbt.drop_toxic(docs, labels), decontam.drop_contaminated(docs, benchmark), secret_scan.redact_secrets(docs), near_texts.keep_one(docs)]
    for out in kept:
        assert out.schema.simpleString() == docs.schema.simpleString()
        rest = [c for c in docs.columns if c not in ("text", "n_chars")]  # a secret in a text is replaced
        rows = [[r[c] for c in rest] for r in docs.collect()]
        assert all([r[c] for c in rest] in rows for r in out.collect()) and 0 < out.count() <= len(rows)


def test_archives_with_text_ids(tables, spark):
    docs = tables[0]
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("my col", "url")
    out = warc.archive_table(pages)
    assert out.schema["page_id"].dataType == out.schema["refers_to"].dataType == docs.schema["doc_id"].dataType
    assert sorted(str(r[0]) for r in out.collect()) == sorted(str(r.page_id) for r in pages.collect())


@pytest.mark.parametrize("rows", [None, 0])
def test_pipeline(tables, spark, tmp_path, rows):
    names = ("documents", "labels", "benchmark")
    for name, t in zip(names, tables, strict=True):
        (t if rows is None else t.limit(rows)).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.columns == columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[0] == "doc_id" and out.count() == docs.count()
    assert (out.count() > 0) == (rows is None)


def test_sample_is_bounded_and_does_not_depend_on_the_order(spark):
    rows = [(i, "x" * (10 + i % 7)) for i in range(50)] + [(i, f"other text {i}") for i in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    take = lambda d, **k: [tuple(r) for r in common.labelled_sample(d, labels, "toxic", common.F.lit(True), 30, 1000, **k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = take(docs.repartition(5))
    assert got == take(docs.repartition(2).orderBy("text")) and len(got) == len({r[0] for r in got}) == 30
    few = take(docs, most=100)
    assert 0 < len(few) < 30 and sum(len(r[2]) for r in few) <= 100 and set(few) <= set(got)


def test_no_machine_local_scratch_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    session = type("S", (), {"conf": type("K", (), {"get": lambda self, name, default: None})(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(session)

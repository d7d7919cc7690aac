"""Category splits, manifests and configurations as tables: one row of text per document, parsed by the tasks.

The same rules as ``annotations.category_split``, ``annotations.known_filtered`` and ``files.dataset_options``,
which read one document on the driver for the command line; here any number of them is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.sources.files import dataset_options


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of the files at a path."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def canonical_value(v: Column) -> Column:
    """A text that is equal for equal values of JSON: 1, 1.0 and true are one, 1 and "1" are not; null for null."""
    kind, number = _kind(v), F.try_variant_get(v, "$", "double")
    whole = F.concat(F.lit("i:"), F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("long")).otherwise(F.try_variant_get(v, "$", "decimal(38,0)")).cast("string"))
    real = kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(v, "$", "string")))
        .when((kind == "BIGINT") | (kind == "BOOLEAN") | real & (number == F.floor(number)), whole)
        .when(real, F.concat(F.lit("f:"), number.cast("string")))
        .otherwise(F.concat(F.lit("j:"), F.to_json(v)))
    )


def _valid_id(v: Column) -> Column:
    return (_kind(v) == "BIGINT") | (_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") != "")


def _field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def category_splits(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, category_id, is_novel), (path, kind, n)) of splits in any of three layouts, and what is wrong
    with them."""
    parsed = texts.select("path", F.parse_json("text").alias("v"))
    listed = _field(F.col("v"), "categories")
    by_row = parsed.filter(F.startswith(_kind(listed), F.lit("ARRAY"))).select("path", F.explode(_field(F.col("v"), "categories", "array<variant>")).alias("c"))
    frequency = F.when(_kind(_field(F.col("c"), "frequency")) == "STRING", _field(F.col("c"), "frequency", "string"))
    fine = F.coalesce(_kind(F.col("c")).startswith("OBJECT") & _valid_id(_field(F.col("c"), "id")), F.lit(False))
    known = F.coalesce(frequency.isin("r", "c", "f"), F.lit(False))
    rows = by_row.filter(fine & known).select("path", canonical_value(_field(F.col("c"), "id")).alias("category_id"), (frequency == "r").alias("is_novel"))
    wrong = by_row.filter(~(fine & known)).select("path", F.when(fine, F.lit("category_split_missing_frequency")).otherwise(F.lit("category_split_invalid_category")).alias("kind"))
    lists = parsed.filter(_kind(listed) == "VOID")
    names = [("base_category_ids", "novel_category_ids"), ("base", "novel")]
    has = [F.startswith(_kind(_field(F.col("v"), a)), F.lit("ARRAY")) & F.startswith(_kind(_field(F.col("v"), b)), F.lit("ARRAY")) for a, b in names]
    for i, pair in enumerate(names):
        own = lists.filter(has[i] if not i else has[i] & ~has[0])
        for name, novel in zip(pair, (False, True), strict=True):
            ids = own.select("path", F.explode(_field(F.col("v"), name, "array<variant>")).alias("c"))
            rows = rows.unionByName(ids.select("path", canonical_value(F.col("c")).alias("category_id"), F.lit(novel).alias("is_novel")))
    unknown = parsed.filter((_kind(listed) != "VOID") & ~F.startswith(_kind(listed), F.lit("ARRAY")) | (_kind(listed) == "VOID") & ~has[0] & ~has[1])
    wrong = wrong.unionByName(unknown.select("path", F.lit("category_split_unrecognized").alias("kind")))
    rows = rows.distinct()
    both = rows.groupBy("path", "category_id").agg(F.count_distinct("is_novel").alias("n")).filter("n > 1")
    wrong = wrong.unionByName(both.select("path", F.lit("category_split_overlap").alias("kind")))
    return rows, wrong.groupBy("path", "kind").agg(F.count("*").alias("n"))


def known_anchors(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, video_id, frame_key, track_id, category_id, reason), (path, kind, n)) of manifests, objects or
    lists, and what is wrong with them."""
    v = F.col("v")
    parsed = texts.select("path", F.parse_json("text").alias("v"))
    is_object = F.startswith(_kind(v), F.lit("OBJECT"))
    entries = F.when(is_object, F.coalesce(_field(v, "filtered_anchors"), _field(v, "anchors"), F.parse_json(F.lit("[]")))).otherwise(v)
    parsed = parsed.select("path", entries.alias("v"))
    whole = F.startswith(_kind(v), F.lit("ARRAY"))
    rows = parsed.filter(whole).select("path", F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("e"))
    e = F.col("e")
    key = {"video_id": _field(e, "video_id"), "frame_key": F.coalesce(_field(e, "frame_index"), _field(e, "frame_id")), "track_id": _field(e, "track_id"), "category_id": _field(e, "category_id")}
    named = rows.select("path", F.startswith(_kind(e), F.lit("OBJECT")).alias("fine"), *[canonical_value(c).alias(n) for n, c in key.items()], F.coalesce(_field(e, "reason", "string"), F.lit("declared filter")).alias("reason"))
    complete = F.col("fine") & F.col("video_id").isNotNull() & F.col("frame_key").isNotNull() & F.col("track_id").isNotNull() & F.col("category_id").isNotNull()
    kind = F.when(F.col("fine"), F.lit("known_filter_manifest_key_invalid")).otherwise(F.lit("known_filter_manifest_entry_invalid"))
    wrong = named.filter(~complete).select("path", kind.alias("kind")).unionByName(parsed.filter(~whole).select("path", F.lit("known_filter_manifest_invalid").alias("kind")))
    return named.filter(complete).drop("fine"), wrong.groupBy("path", "kind").agg(F.count("*").alias("n"))


def configured(texts: DataFrame) -> DataFrame:
    """(path, file, ann_file, interval) of configurations for the annotation file beside each: columns path, text,
    file. Sources are parsed in the tasks, and never run; files that none refers to have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dataset_options(text or "", file) or {} for text, file in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            interval = [o.get("interval") if isinstance(o.get("interval"), int) else None for o in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([o.get("ann_file") for o in found], pa.string()), pa.array(interval, pa.int32())], names=["path", "file", "ann_file", "interval"])

    return texts.select("path", "text", "file").mapInArrow(run, "path string, file string, ann_file string, interval int")

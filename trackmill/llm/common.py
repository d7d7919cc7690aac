"""Helpers shared by the text operators: narrow reads, Arrow text buffers, scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkAttributeError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bounds of one Arrow batch handed to a Python worker; a longer text makes a batch of its own.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Bound of the text that a model is fitted on.
SAMPLE_BYTES = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep a Python worker's input small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(docs: DataFrame) -> list[Column]:
    return [column(c) for c in docs.columns]


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct, ``row``, so that a Python step can hand it on whole."""
    return docs.select(F.struct(*columns(docs)).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, name: str = "row") -> list[Column]:
    """The columns of ``docs`` out of the struct ``name`` of ``rows``."""
    return [F.col(name).getField(c).alias(c) for c in docs.columns]


def text_input(docs: DataFrame, key: str, text: str | None) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """What a Python step over texts reads, and where a batch's texts are: beside the key, or with
    ``text`` None in the key itself, a struct of a whole row, which then is sent once."""
    if text is None:
        return docs.select(column(key).alias("key")), lambda batch: batch.column(0).field("text")
    return docs.select(column(key).alias("key"), column(text).alias("text")), lambda batch: batch.column(1)


def keyed_schema(narrow: DataFrame, rest: str) -> StructType:
    """The first column of ``narrow`` with its own type, then the columns of ``rest``."""
    first = narrow.schema[0]
    return StructType([StructField(first.name, first.dataType), *StructType.fromDDL(rest)])


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; one of this machine only where the master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    current = context.getCheckpointDir()
    if current.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trackmill-"))
        current = context.getCheckpointDir()
    return current.get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM is gone: the cluster's own clean-up takes the folder
        pass


def opened(uri: str):
    """Arrow's file system of a scratch path (local, hdfs, s3, gs), and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file whose results are sent back in one small file.
BLOCK_ROWS = 20_000


def parquet_table(docs: DataFrame) -> bool:
    """Whether the rows are those of a Parquet table as it lies, so that file and row number name them."""
    try:
        plan = docs._jdf.queryExecution().analyzed()
        return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower() and "_metadata" not in docs.columns
    except (AttributeError, PySparkAttributeError):  # a session that does not show its plans
        return False


def with_places(docs: DataFrame) -> DataFrame:
    """(file, row, data): each row as one struct, and its place in a Parquet table; what is none is written."""
    if not parquet_table(docs):
        docs = materialize(docs, "rows")
    file = F.sha1(F.col("_metadata.file_path").cast("binary"))
    return docs.select(file.alias("file"), F.col("_metadata.row_index").alias("row"), F.struct(*columns(docs)).alias("data"))


def write_places(rows: DataFrame, path: str) -> None:
    """Write (file, row, ...) in small files by file and block of rows, for ``place_rows``."""
    block = F.floor(F.col("row") / BLOCK_ROWS).alias("block")
    rows.select("*", block).repartition("file", "block").write.partitionBy("file", "block").parquet(path)


def place_rows(folder: str, name: str) -> Callable[[pa.Array, pa.Array], list]:
    """A look-up for tasks: the values of a column that ``write_places`` has for the rows given by file and
    row number, None for others. One block is held at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    store, path = opened(folder)
    here: tuple[str, int] | None = None
    held: dict[int, object] = {}

    def look(files: pa.Array, rows: pa.Array) -> list:
        nonlocal here, held
        out = []
        for file, row in zip(files.to_pylist(), rows.to_pylist(), strict=True):
            if (file, row // BLOCK_ROWS) != here:
                here, held = (file, row // BLOCK_ROWS), {}
                for info in store.get_file_info(FileSelector(f"{path}/file={file}/block={here[1]}", allow_not_found=True)):
                    if info.path.endswith(".parquet"):
                        with store.open_input_file(info.path) as source:
                            found = pq.ParquetFile(source).read()
                        held.update(zip(found["row"].to_pylist(), found[name].to_pylist(), strict=True))
            out.append(held.get(row))
        return out

    return look


def text_slices(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column; null counts as empty."""
    raw, offsets = text_buffer(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield raw[a:b]


def text_buffer(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts of an Arrow string column as one byte string and the n + 1 offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = data.to_pybytes() if data is not None else b""
    return raw, offsets


def code_points(raw: bytes, positions: list[int]) -> list[int]:
    """Code point offsets of byte positions in valid UTF-8."""
    if not positions or raw.isascii():
        return positions
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.r_[0, np.cumsum(starts)][positions].tolist()


def fold(key: str, parts: int):
    """crc32 of the id as text, modulo parts; an id that is null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable, rows: int, chars: int, extra: tuple[str, ...] = (), most: int = SAMPLE_BYTES
) -> list:
    """At most ``rows`` labelled documents of at most ``chars`` characters, of ``most`` bytes together, as
    (doc_id, label, text, *extra), for fitting a model on the driver.

    The rows are those with the smallest hashes of their ids, so the sample does not depend on how the
    tables lie; of several labels of one id the largest counts, of several texts of one id the one with
    the smallest hash. Only the ids, whose number is bounded, are broadcast.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & column(label).isNotNull()).filter(usable)
    marked = marked.groupBy("doc_id").agg(F.max(column(label)).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *map(column, extra)).filter(F.char_length("text") <= chars)
    found = texts.join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label", *map(column, extra))).alias("r"))
    one = materialize(one.select("doc_id", F.xxhash64("doc_id").alias("place"), "r.label", "r.text", *[F.col("r").getField(c).alias(c) for c in extra]), "sample")
    sizes = sorted(one.select("place", "doc_id", F.octet_length("text").alias("size")).collect())  # at most ``rows`` rows
    within = int(np.searchsorted(np.cumsum([r.size for r in sizes]), most, "right"))
    if within < len(sizes):
        last = sizes[within]
        one = one.filter((F.col("place") < last.place) | (F.col("place") == last.place) & (F.col("doc_id") < last.doc_id))
    return sorted(one.select("doc_id", "label", "text", *map(column, extra)).collect(), key=lambda r: (r[0], r[2]))

"""Sources beside annotation documents: frame folders, detection files, vocabularies, configurations."""

from __future__ import annotations

import ast
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.operators.aggregates import chunked
from trackmill.sources.scratch import opened


def frame_files(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, video, file_name) of all frame files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"), F.substring_index("path", "/", -1).alias("file_name"))


def clips(files: DataFrame, size: int, min_length: int = 0) -> DataFrame:
    """Full chunks of consecutive frames of each video that has more than ``min_length``."""
    return chunked(files, size, min_length, "video", "file_name")


#: Rows that a task writes as files of their own.
FILES_PER_TASK = 1000


def write_files(files: DataFrame, path: str) -> None:
    """Write the text of each row (folder, value) as a JSON file of its own below ``path``, in its folder or,
    where that is null, in one of its task's. Rows are dealt to as many tasks as their number asks for, and a
    task that is repeated writes its files over again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(path)
        part, made, n = f"{TaskContext.get().partitionId():06}", set(), 0
        for batch in batches:
            for folder, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = f"{top}/{part if folder is None else folder}"
                if own not in made:
                    store.create_dir(own, recursive=True)
                    made.add(own)
                with store.open_output_stream(f"{own}/{part}-{n:06}.json", compression=None) as out:
                    out.write((value or "").encode())
                n += 1
            yield batch.slice(0, 0)

    tasks = -(-files.count() // FILES_PER_TASK)
    if not tasks:
        store, top = opened(path)
        store.create_dir(f"{top}/{0:06}", recursive=True)  # an empty folder can be read, none can't
    dealt = files.select(F.col("folder").cast("string"), "value").repartition(max(1, tasks))
    dealt.mapInArrow(write, "folder string, value string").write.format("noop").mode("overwrite").save()


def detection_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, json_name, corrupt) of detection files, one object each; what cannot be parsed is
    kept and marked, not fatal."""
    schema = "file_name string, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select("file_name", F.col("_metadata.file_name").alias("json_name"), F.col("_corrupt").isNotNull().alias("corrupt"))


def uncovered(files: DataFrame, manifest: DataFrame, key: str = "file_name") -> DataFrame:
    """Files that the manifest does not list."""
    return files.join(manifest.select(key).distinct(), key, "left_anti")


def class_name(file_name: Column) -> Column:
    """A class from a file name: no extension, no digits at the end, words of CamelCase apart."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), r"\d+$", "")
    return F.lower(F.regexp_replace(stem, r"(?<!^)(?=[A-Z])", " "))


def dataset_options(source: str, annotation_file: str) -> dict | None:
    """The literal options of the last dict(ann_file=...) call of a Python configuration whose file has
    the given base name; the source is parsed, never run."""
    found = None
    for node in ast.walk(ast.parse(source)):
        if not (isinstance(node, ast.Call) and getattr(node.func, "id", None) == "dict"):
            continue
        options = {}
        for k in node.keywords:
            try:
                options[k.arg] = ast.literal_eval(k.value)
            except ValueError:
                continue
        name = options.get("ann_file")
        if isinstance(name, str) and name.rsplit("/", 1)[-1] == annotation_file:
            found = options
    return found


#: What a loader's source holds if it reads the annotations of the listed classes only: fixed values.
FILTER_SIGNS = ("get_ann_ids", "cat_ids=self.cat_ids", 'ann["category_id"] not in self.cat_ids')


def filters_classes(path: str) -> bool:
    """Whether a loader's source, a file with its folder's other sources or a folder, filters by class."""
    folder = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
    text = ""
    for name in sorted(os.listdir(folder)):
        if name.endswith(".py"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                text += f.read() + "\n"
    return all(sign in text for sign in FILTER_SIGNS)


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size_bytes, sha256) of files, each read by one task, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                store, name = opened(path)
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(name, compression=None) as stream:
                    while block := stream.read(8 << 20):
                        digest.update(block)
                        size += len(block)
                found.append((path, size, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["path", "size_bytes", "sha256"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return listed.mapInArrow(run, "path string, size_bytes long, sha256 string")


def concatenated(*datasets: DataFrame) -> DataFrame:
    """Datasets one after the other, each row with its dataset's number."""
    out = None
    for i, df in enumerate(datasets):
        part = df.withColumn("dataset", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def blob_keys(path: Column, layout: str) -> Column:
    """The key under which a blob store of a layout keeps an image: the last three parts of its path
    (tao), two (lasot, bdd) or one (key, lvis)."""
    depth = {"tao": -3, "lasot": -2, "bdd": -2, "key": -1, "lvis": -1}
    return F.substring_index(path, "/", depth[layout])

"""Experiment logs as tables: text blocks of ten metrics for Combined, Base and Novel classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the order of the metrics in a block.
METRICS = ["TETA", "LocS", "AssocS", "ClsS", "LocRe", "LocPr", "AssocRe", "AssocPr", "ClsRe", "ClsPr"]


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


#: What a block of each kind begins with, as patterns.
TOP_K, CONFIG, EPOCH = r"max_instance_per_cate:", r"work_dirs/", r"epoch\["
#: Between blocks of the kinds that blank lines part.
BLANK = r"\n[ \t\r]*\n"


def _blocks(logs: DataFrame, mark: str, text: str = "text", keep: tuple[str, ...] = (), apart: str | None = None) -> DataFrame:
    """(keep, lines): the lines that are not blank of each piece that begins with the mark. Pieces are cut
    before each mark or, with ``apart``, at what that matches."""
    cut = logs.select(*keep, F.explode(F.split(text, apart or f"(?={mark})")).alias("block"))
    trimmed = F.transform(F.split("block", "\n"), lambda line: F.btrim(line, F.lit(" \t\r")))
    lines = cut.select(*keep, F.filter(trimmed, lambda line: line != "").alias("lines"))
    return lines.filter(F.get("lines", F.lit(0)).rlike(f"^{mark}"))


def _in_brackets(line: Column, *names: str) -> list[Column]:
    """The values in a line's square brackets, in order, by name."""
    found = F.regexp_extract_all(line, F.lit(r"\[([^\[\]]*)\]"), 1)
    return [F.get(found, F.lit(i)).alias(n) for i, n in enumerate(names)]


def _lines(blocks: DataFrame, keys: list[Column], named: bool = True, exact: int | None = None) -> DataFrame:
    """(keys, names, t) of blocks of a key line, a header and value lines: the words of each value line, a
    category and its values. Metrics are named by the header's words after its first, or by METRICS."""
    words = lambda line: F.split(line, r"[ \t]+")
    after_first = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    names = after_first(words(F.get("lines", F.lit(1)))) if named else F.array(*[F.lit(m) for m in METRICS])
    values = F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))
    rows = blocks.filter(F.size("lines") > 2).select(*keys, names.alias("names"), F.explode(F.transform(values, words)).alias("t"))
    return rows.filter(F.size("t") == exact if exact else F.size("t") > 1)


def _rows(blocks: DataFrame, keys: list[Column], named: bool = True, exact: int | None = None) -> DataFrame:
    """(keys, category, metric, value as text) of such blocks; a value that a line lacks is N/A."""
    rows = _lines(blocks, keys, named, exact)
    cells = F.transform("names", lambda n, i: F.struct(n.alias("metric"), F.coalesce(F.get("t", i + 1), F.lit("N/A")).alias("value")))
    fixed = rows.columns[: len(keys)]
    return rows.select(*fixed, F.get("t", F.lit(0)).alias("category"), F.inline(cells))


def _key_line() -> Column:
    return F.get("lines", F.lit(0))


def top_k_log(logs: DataFrame) -> DataFrame:
    """LOG-1: blocks of max_instance_per_cate, with the first number of their key line."""
    return _rows(_blocks(logs, TOP_K), [F.regexp_extract(_key_line(), r"(\d+)", 1).alias("max_instance")])


def checkpoint_log(logs: DataFrame) -> DataFrame:
    """LOG-2: configuration files, their epochs, three rows each."""
    configs = _blocks(logs, CONFIG + r"[^\n]+\.py")
    rest = F.array_join(F.slice("lines", 2, F.size("lines")), "\n")
    epochs = _blocks(configs.select(_key_line().alias("config"), rest.alias("epochs")), EPOCH, "epochs", ("config",))
    return _rows(epochs, [F.col("config"), *_in_brackets(_key_line(), "epoch")])


def match_score_log(logs: DataFrame) -> DataFrame:
    """LOG-3: blocks of epoch and match score, parted by blank lines; the header names no metric."""
    return _rows(_blocks(logs, EPOCH, apart=BLANK), _in_brackets(_key_line(), "epoch", "match_score"), named=False)


def search_log(logs: DataFrame) -> DataFrame:
    """LOG-4: epoch, match score and box limit; lines of exactly eleven words, values as numbers."""
    rows = _rows(_blocks(logs, EPOCH, apart=BLANK), _in_brackets(_key_line(), "epoch", "match_score", "max_bbox"), named=False, exact=1 + len(METRICS))
    return rows.withColumn("value", F.col("value").try_cast("double"))


def threshold_log(logs: DataFrame) -> DataFrame:
    """LOG-5: epoch and threshold; the header names the columns."""
    return _rows(_blocks(logs, EPOCH), _in_brackets(_key_line(), "epoch", "match_score"))


def threshold_lines(logs: DataFrame) -> DataFrame:
    """The lines of such a log, for ``wide_lines``."""
    return _lines(_blocks(logs, EPOCH), _in_brackets(_key_line(), "epoch", "match_score"))


def wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One column per metric, for a CSV file."""
    return rows.repartition(*keys, "category").groupBy(*keys, "category").pivot("metric", METRICS).agg(F.first("value"))


def wide_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The same of the lines of a log: each line's values are put in columns where
    it lies, and only whole lines meet by their keys, shuffled before they are sorted."""
    at = lambda m: F.array_position("names", F.lit(m)).cast("int")
    value = lambda m: F.when(at(m) > 0, F.coalesce(F.get("t", at(m)), F.lit("N/A"))).alias(m)
    rows = lines.select(*keys, F.get("t", F.lit(0)).alias("category"), *map(value, METRICS)).repartition(*keys, "category")
    return rows.groupBy(*keys, "category").agg(*[F.first(m, ignorenulls=True).alias(m) for m in METRICS])


def log_block(title: Column, values: dict[str, Column]) -> Column:
    """A block's text: the header, and a line per entry of its ten values (an array), in columns of ten
    characters with three decimals."""
    cells = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%-10.3f", x)), " ")
    head = F.lit(" ".join(f"{m:<10}" for m in ["TETA50:", *METRICS]))
    return F.concat_ws("\n", title, head, *[F.concat(F.lit(f"{name:<10} "), cells(v)) for name, v in values.items()])

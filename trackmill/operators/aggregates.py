"""Aggregations, windows, top-k, sampling and format operators over tracks and categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.sources.scratch import kept


def majority_category(df: DataFrame, track: str = "track_id", category: str = "category_id") -> DataFrame:
    """Every row with its track's most frequent category, the smallest of several; rows without a track go.

    The vote is counted per (track, category) first, so a track's rows never meet in one task.
    """
    votes = df.filter(F.col(track).isNotNull()).groupBy(track, category).agg(F.count(F.lit(1)).alias("n"))
    winner = votes.groupBy(track).agg(F.max_by(category, F.struct("n", -F.col(category))).alias("_winner"))
    return df.join(winner, track).withColumn(category, F.col("_winner")).drop("_winner").select(df.columns)


def error_counts(errors: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, n) for every group, zero where there is no error."""
    counts = errors.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("n"))


def first_examples(errors: DataFrame, cap: int, kind: str = "kind", order: str = "ord") -> DataFrame:
    """The first so many rows of each kind."""
    w = Window.partitionBy(kind).orderBy(order)
    return errors.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def class_shares(annotations: DataFrame, split: DataFrame) -> DataFrame:
    """(base, novel, unclassified): annotation counts by a split (category_id, is_novel)."""
    joined = annotations.join(split, "category_id", "left")
    return joined.agg(F.count_if(~F.col("is_novel")).alias("base"), F.count_if("is_novel").alias("novel"), F.count_if(F.col("is_novel").isNull()).alias("unclassified"))


def changed_fields(diff: DataFrame) -> DataFrame:
    """(field, n) over the changed arrays of a diff."""
    return diff.select(F.explode("changed").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def category_counts(annotations: DataFrame, categories: DataFrame, image: str = "image_id") -> DataFrame:
    """(id, instance_count, image_count) of every category, zero where unseen."""
    seen = annotations.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("i"), F.count_distinct(image).alias("m"))
    return categories.select("id").join(seen, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("instance_count"), F.coalesce("m", F.lit(0)).alias("image_count"))


def split_means(metrics: DataFrame, values: list[str], split: str = "split") -> DataFrame:
    """Element-wise means per class subset and of all classes (combined)."""
    means = [F.avg(v).alias(v) for v in values]
    both = metrics.groupBy(split).agg(*means)
    return metrics.agg(*means).select(F.lit("combined").alias(split), *values).unionByName(both)


def first_argmax(score: str, index: str) -> Column:
    """The index of the largest score, the smallest of several."""
    return F.max_by(index, F.struct(F.col(score), -F.col(index)))


def top_per_category(df: DataFrame, k: Column | int, only: Column | None = None, category: str = "category_id", score: str = "score") -> DataFrame:
    """The k best rows of each category, ties in input order; categories outside ``only`` pass whole."""
    if only is not None:  # the others are not ranked, so the limit holds inside the window
        among = F.coalesce(only, F.lit(False))
        return top_per_category(df.filter(among), k, None, category, score).unionByName(df.filter(~among))
    w = Window.partitionBy(category).orderBy(F.col(score).desc(), "ord")
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def top_per_frame(df: DataFrame, k: int, frame: list[str], score: str = "score") -> DataFrame:
    w = Window.partitionBy(*frame).orderBy(F.col(score).desc(), "ord")
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def unique_track_ids(df: DataFrame, video: str = "video_id", track: str = "track_id") -> DataFrame:
    """Track ids made unique over videos: each video's are moved past the largest of those before.

    The running offset runs over one row per video, in ranges of consecutive videos of about equal
    numbers: their sums are added up first, so no task sees all videos.
    """
    top = df.groupBy(video).agg(F.coalesce(F.max(track) + 1, F.lit(0)).alias("span"))
    top = kept(top.repartitionByRange(video).withColumn("_block", F.spark_partition_id()), "spans")
    blocks = top.groupBy("_block").agg(F.sum("span").alias("_s"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_block").orderBy(video).rowsBetween(Window.unboundedPreceding, -1)
    offset = top.join(blocks, "_block").select(video, (F.col("_base") + F.coalesce(F.sum("span").over(inner), F.lit(0))).alias("_offset"))
    return df.join(offset, video).withColumn(track, F.col(track) + F.col("_offset")).drop("_offset").select(df.columns)


def dense_frames(df: DataFrame, video: str = "video_id", order: str = "frame_index") -> DataFrame:
    """frame_id 0, 1, ... by order in each video, and frame_range, the second order value less the first."""
    w = Window.partitionBy(video).orderBy(order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.nth_value(order, 2).over(all_) - F.first_value(order).over(all_)
    return df.withColumn("frame_id", (F.row_number().over(w) - 1).cast("long")).withColumn("frame_range", gap)


def identical_runs(df: DataFrame, length: int, track: str = "track_id", order: str = "frame_id") -> DataFrame:
    """The rows at which a run of equal boxes reaches a length, once per run."""
    w = Window.partitionBy(track).orderBy(order)
    same = F.struct("x1", "y1", "x2", "y2").eqNullSafe(F.lag(F.struct("x1", "y1", "x2", "y2")).over(w))
    marked = df.withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(w))
    ranked = marked.withColumn("_n", F.row_number().over(Window.partitionBy(track, "_run").orderBy(order)))
    return ranked.filter(F.col("_n") == length).select(df.columns)


# --- sampling -----------------------------------------------------------------------------------


def strided(df: DataFrame, interval: int, key: str = "video_id", order: str = "frame_id") -> DataFrame:
    """Every interval-th frame of each sequence, from the first."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.dense_rank().over(w) - 1).filter(F.col("_n") % interval == 0).drop("_n")


def hashed_pick(df: DataFrame, k: Column | int, group: list[str], by: str, seed: int = 42) -> DataFrame:
    """So many rows of each group, those with the smallest hashes: the same ones in every run."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), F.col(by)), by)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def contiguous_crop(df: DataFrame, length: int, start: Column, key: str = "video_id", order: str = "frame_id") -> DataFrame:
    """A run of ``length`` frames of each sequence from a start taken modulo what fits."""
    ranked = df.withColumn("_n", F.dense_rank().over(Window.partitionBy(key).orderBy(order)) - 1)
    ranked = ranked.withColumn("_room", F.greatest(F.lit(1), F.max("_n").over(Window.partitionBy(key)) + 2 - length))
    first = F.pmod(start, F.col("_room"))
    return ranked.filter((F.col("_n") >= first) & (F.col("_n") < first + length)).drop("_n", "_room")


def two_segments(df: DataFrame, length: int, span: int, start: Column, second: Column, key: str = "video_id", order: str = "frame_id") -> DataFrame:
    """Two runs of half of ``length`` frames of each sequence within ``span`` frames, with their number:
    the first from a start, the second from one after it, both taken modulo what fits. Sequences shorter
    than ``length`` have none."""
    half = length // 2
    frames = df.select(key, order).distinct()
    ranked = frames.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    ranked = ranked.filter(F.col("_all") >= length).withColumn("_a", F.pmod(start, F.col("_all") - length + 1))
    last = F.least(F.col("_all") - half, F.col("_a") + span - half)
    ranked = ranked.withColumn("_b", F.col("_a") + half + F.pmod(second, F.greatest(last - F.col("_a") - half + 1, F.lit(1))))
    inside = lambda at: (F.col("_n") >= F.col(at)) & (F.col("_n") < F.col(at) + half)
    segments = F.array_compact(F.array(F.when(inside("_a"), F.lit(0)), F.when(inside("_b"), F.lit(1))))
    return df.join(ranked.select(key, order, F.explode(segments).alias("segment")), [key, order])


def uniform_reference(df: DataFrame, scope: int, draw: Column | None = None, keep_self: bool = False, seed: int = 42, key: str = "video_id", order: str = "frame_id") -> DataFrame:
    """(key, frame, ref): each frame with one of those up to ``scope`` places around it, but itself, each
    as likely as the others. ``draw`` is a whole number per frame, by default its hash; without frames
    around it, with ``scope`` 0 or with ``keep_self`` a frame is its own reference."""
    frames = df.select(key, order).distinct()
    if scope <= 0 or keep_self:
        return frames.withColumn("ref", F.col(order))
    draw = F.xxhash64(key, order, F.lit(seed)) if draw is None else draw
    near = F.collect_list(order).over(Window.partitionBy(key).orderBy(order).rowsBetween(-scope, scope))  # at most 2 * scope + 1
    others = F.array_remove(near, F.col(order))
    chosen = F.get(others, F.pmod(draw, F.greatest(F.size(others), F.lit(1))).cast("int"))
    return frames.select(key, order, F.coalesce(chosen, F.col(order)).alias("ref"))


def redrawn(samples: DataFrame, usable: Column, draw: Column | None = None, seed: int = 42, group: str = "video_id", sample: str = "frame_id") -> DataFrame:
    """(group, sample, used): each sample with itself if it is usable, else with a usable one of its group,
    each as likely as the others; samples of groups without any go. ``draw`` is a whole number per sample,
    by default its hash.

    A place among the usable ones is drawn once, which gives what drawing again until one is usable does.
    """
    draw = F.xxhash64(group, sample, F.lit(seed)) if draw is None else draw
    marked = samples.select(group, sample, F.coalesce(usable, F.lit(False)).alias("_ok"), draw.cast("long").alias("_draw"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(sample)) - 1
    good = marked.filter("_ok").select(group, F.col(sample).alias("used"), place.cast("long").alias("_at"))
    sizes = good.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    again = marked.filter("NOT _ok").join(sizes, group).select(group, sample, F.pmod("_draw", "_n").alias("_at"))
    return marked.filter("_ok").select(group, sample, F.col(sample).alias("used")).unionByName(again.join(good, [group, "_at"]).select(group, sample, "used"))


def chunked(df: DataFrame, size: int, min_length: int = 0, key: str = "video_id", order: str = "frame_id") -> DataFrame:
    """Full chunks of ``size`` consecutive frames of sequences longer than ``min_length``; the rest goes."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_n", F.row_number().over(w.orderBy(order)) - 1).withColumn("_all", F.count(F.lit(1)).over(w))
    out = ranked.withColumn("chunk", F.floor(F.col("_n") / size)).filter((F.col("_all") > min_length) & (F.col("chunk") < F.floor(F.col("_all") / size)))
    return out.drop("_n", "_all")


def shard_starts(videos: DataFrame, n: int, start: str = "start", size: str = "size", total: str = "total") -> DataFrame:
    """(shard, start): for each shard the video start nearest to its even share, the first of several.

    A shard's share falls into one video, whose start and end are the only candidates.
    """
    per = F.col(total) / n
    low, high = F.ceil(F.col(start) / per), F.least(F.floor((F.col(start) + F.col(size)) / per), F.lit(n - 1))
    inside = videos.filter(low <= high).select(start, size, total, F.explode(F.sequence(low, high)).alias("shard"))
    ends = F.array(F.col(start), F.when(F.col(start) + F.col(size) < F.col(total), F.col(start) + F.col(size)))
    near = inside.select("shard", total, F.explode(F.array_compact(ends)).alias(start))
    gap = F.abs(F.col(start) - F.col("shard") * F.col(total) / n)
    return near.groupBy("shard").agg(F.min_by(start, F.struct(gap, F.col(start))).alias(start))


def trident(df: DataFrame, scope: int, key: str = "video_id", frame: str = "frame_id", track: str = "track_id") -> DataFrame:
    """(key, frame, before, after): for each frame the farthest one within ``scope`` on either side that
    shares a track with it, or the frame itself where there is none."""
    seen = df.select(key, frame, track).distinct()
    w = Window.partitionBy(key, track).orderBy(frame)
    near = seen.withColumn("before", F.min(frame).over(w.rangeBetween(-scope, -1))).withColumn("after", F.max(frame).over(w.rangeBetween(1, scope)))
    return near.groupBy(key, frame).agg(F.coalesce(F.min("before"), F.col(frame)).alias("before"), F.coalesce(F.max("after"), F.col(frame)).alias("after"))


def global_rank(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """The 0-based place of each row by an order column, the row count beside it; ties by the whole row.

    Rows are dealt to ranges of about equal numbers and sorted there; a row's place is its place in its
    range and the rows of the ranges before, of which only the counts meet in one place.
    """
    tie = F.xxhash64(*df.columns)
    ranged = df.repartitionByRange(F.col(order), tie).sortWithinPartitions(F.col(order), tie)
    # an increasing id holds the range's number above its 33 low bits and the place in it below
    ranged = kept(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_id", 33))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(all_).alias("n_rows"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(counts, "_part").select(*df.columns, (F.col("_base") + inside).alias(name), "n_rows")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Each row with the sums, up to it, of columns (``sums`` names column and sum) over the rows with its
    keys, in order; ties by the whole row.

    Rows are dealt to ranges by keys and order, so a key of any size is spread over tasks; of each range and
    key only the sums meet.
    """
    tie = F.xxhash64(*df.columns)
    place = [*map(F.col, keys), *map(F.col, order), tie]
    ranged = df.repartitionByRange(*place).sortWithinPartitions(*place)
    ranged = kept(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    base = base.select("_part", *keys, *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_part", *keys).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.select("*", *[F.sum(c).over(inside).alias(f"_to_{c}") for c in sums])
    joined = run.join(base, ["_part", *keys])
    return joined.select(*df.columns, *[(F.col(f"_{c}") + F.col(f"_to_{c}")).alias(name) for c, name in sums.items()])


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Every row with rank, dense_rank, percent_rank and cume_dist of its value among all rows (nulls first).

    Rows are counted by value before they are ranked, and only values meet in order, in ranges of them.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n")).withColumns({"_one": F.lit(1).cast("long"), "_all": F.lit(0)})
    run = running_sums(counts, ["_all"], [value], {"_n": "_upto", "_one": "dense_rank"})
    total = counts.agg(F.sum("_n").alias("_rows"))
    before = F.col("_upto") - F.col("_n")
    ranks = run.crossJoin(F.broadcast(total)).select(  # one row
        F.col(value).alias("_value"), (before + 1).alias("rank"), "dense_rank",
        F.coalesce(F.try_divide(before, F.col("_rows") - 1), F.lit(0.0)).alias("percent_rank"), (F.col("_upto") / F.col("_rows")).alias("cume_dist"),
    )
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def even_parts(df: DataFrame, x: int, order: str) -> DataFrame:
    """Parts 0 .. x-1 of almost equal size in order; the first ones are larger by one row."""
    ranked = global_rank(df, order, "_rank")
    size, more = F.floor(F.col("n_rows") / x), F.col("n_rows") % x
    head = more * (size + 1)
    part = F.when(F.col("_rank") < head, F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor((F.col("_rank") - head) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("part", part).drop("_rank", "n_rows")


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def balance_factors(annotations: DataFrame, threshold: float, image: str = "image_id", category: str = "category_id") -> DataFrame:
    """(image, factor): how often an image is repeated so that rare categories are seen often enough:
    the largest over its categories of max(1, sqrt(threshold / share of images with the category))."""
    seen = annotations.select(image, category).distinct()
    total = seen.select(image).distinct().agg(F.count(F.lit(1)).alias("_total"))
    share = seen.groupBy(category).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total))
    factor = share.select(category, F.greatest(F.lit(1.0), F.sqrt(threshold / (F.col("_n") / F.col("_total")))).alias("_f"))
    return seen.join(factor, category).groupBy(image).agg(F.ceil(F.max("_f")).alias("factor"))


def original_frames(frames: DataFrame, ratio: float, seed: int = 42, key: str = "video_id", frame: str = "frame_id") -> DataFrame:
    """(key, frame): a video's original frames (is_ori) and int(n * ratio) of its others, drawn without
    replacement by the standard generator with the same seed for every video; all if there are fewer.

    A group is one video's frame numbers, which fit in a task however many videos there are.
    """
    import random

    import pandas as pd

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        chosen = part.loc[part["is_ori"], frame].tolist()
        others = list(set(part[frame].tolist()) - set(chosen))
        n = int(len(chosen) * ratio)
        extra = others if len(others) < n else random.Random(seed).sample(others, n)
        return pd.DataFrame({key: part[key].iloc[0], frame: sorted(chosen + extra)})

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.groupBy(key).applyInPandas(draw, f"{key} {kinds[key]}, {frame} {kinds[frame]}")


def sampled_pairs(frames: DataFrame, reach: tuple[int, int] = (-5, 5), positive: Column | float = 0.8, with_self: bool = True, seed: int = 42, key: str = "video_id", frame: str = "frame_id", draw: Callable[[str], Column] | None = None) -> DataFrame:
    """(key, frame, pair_key, pair_frame, positive): each frame with one other, picked by hash.

    A positive pair's frame is of the same video, from reach[0] places before up to, but without,
    reach[1] places after; without ``with_self`` the frame itself is left out, unless it is the only
    one. Any frame of any other video makes a negative pair. ``positive`` is a probability, or says
    it of each frame; where there is no other video, a negative pair's other side is null. Keys are whole
    numbers. ``draw`` gives a whole number per frame for each named choice, by default a hash.
    """
    draw = draw or (lambda name: F.xxhash64(key, frame, F.lit(seed), F.lit(name)))
    pick = lambda name, n: F.pmod(draw(name), n)
    chance = positive if isinstance(positive, Column) else pick("positive", F.lit(1 << 30)) < positive * (1 << 30)
    place = (F.row_number().over(Window.partitionBy(key).orderBy(frame)) - 1).cast("long")
    placed = frames.select(key, frame, place.alias("_at"), chance.alias("positive"))
    videos = global_rank(frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "_video")
    others = videos.select(F.col("_video").alias("_other"), F.col(key).alias("pair_key"), F.col("_n").alias("_size"))
    low, high = F.greatest(F.col("_at") + reach[0], F.lit(0)), F.least(F.col("_at") + reach[1], F.col("_n"))
    count = F.greatest(high - low, F.lit(1))
    near = F.when(high > low, low + pick("near", count)).otherwise(F.col("_at"))
    if not with_self:
        behind = F.col("_at").between(low, high - 1).cast("long")
        near = low + pick("near", F.greatest(count - behind, F.lit(1)))
        near = F.when(count - behind < 1, F.col("_at")).otherwise(near + ((behind == 1) & (near >= F.col("_at"))).cast("long"))
    away = F.pmod(F.col("_video") + 1 + pick("video", F.greatest(F.col("n_rows") - 1, F.lit(1))), F.col("n_rows"))
    drawn = placed.join(videos, key)
    drawn = drawn.withColumn("_other", F.when(F.col("positive"), F.col("_video")).when(F.col("n_rows") > 1, away)).join(others, "_other", "left")
    drawn = drawn.withColumn("_pair", F.when(F.col("positive"), near).otherwise(pick("frame", F.col("_size"))))
    partner = placed.select(F.col(key).alias("pair_key"), F.col("_at").alias("_pair"), F.col(frame).alias("pair_frame"))
    return drawn.select(key, frame, "pair_key", "_pair", "positive").join(partner, ["pair_key", "_pair"], "left").select(key, frame, "pair_key", "pair_frame", "positive")

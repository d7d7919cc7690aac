"""Sketches against exact counts, plans of laid-out joins, ranks and calendars."""

import random

import pytest
from pyspark.sql import functions as F

from trackmill.operators import join_plans as J
from trackmill.operators import sketches as S
from trackmill.operators.aggregates import value_ranks
from trackmill.operators.calendars import local_days
from trackmill.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(1)
    rows = [(i % 10, rng.choice("ab"), int(rng.paretovariate(0.6)) % 50_000, rng.gauss(100, 30)) for i in range(30_000)]
    return spark.createDataFrame(rows, "day int, kind string, user long, v double").repartition(4)


def test_merged_sketches_are_within_their_bounds(spark, visits):
    daily = S.sketched(visits, ["day", "kind"], "user", "v", "user")
    assert daily.count() == 20
    for keys in ([], ["kind"], ["day"]):
        got = S.estimated(S.merged(daily, keys), [0.1, 0.5, 0.99], 3).collect()
        for r in got:
            own = visits.filter(" AND ".join([f"{k} = '{r[k]}'" for k in keys]) or "true")
            exact = own.agg(F.count("*").alias("n"), F.count_distinct("user").alias("d"), *[F.avg((F.col("v") <= q).cast("int")).alias(f"q{i}") for i, q in enumerate(r["quantiles"])]).first()
            assert r["n"] == exact["n"] and abs(r["distincts"] - exact["d"]) <= 4 * S.DISTINCT_ERROR * exact["d"]
            assert all(abs(exact[f"q{i}"] - q) <= 4 * S.RANK_ERROR for i, q in enumerate((0.1, 0.5, 0.99)))
            top = {t["item"]: t["count"] for t in r["top"]}
            counts = {x.user: x["count"] for x in own.groupBy("user").count().collect()}
            assert max(counts.values()) in top.values() and all(abs(counts[u] - c) <= exact["n"] / S.ITEMS for u, c in top.items())
    assert all(r["distincts"] > 100 for r in got)


def test_cubes_add_sketches_up(visits):
    daily = S.sketched(visits, ["day", "kind"], "user", "v", "user")
    cube = S.estimated(S.merged_cube(daily, ["day", "kind"]), [0.5], 1).collect()
    assert sorted({r["level"] for r in cube}) == [0, 1, 2, 3] and len(cube) == 20 + 10 + 2 + 1
    assert all(sum(r["n"] for r in cube if r["level"] == level) == 30_000 for level in range(4))


def test_a_cube_over_more_users_than_a_sketch_holds_counts_its_most_frequent_one(spark, tmp_path):
    n = 9000  # a sketch counts about 6,000 exactly and names none of more that are equally frequent
    e = spark.range(2 * n + 3).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-02 00:00:00'").alias("ts"), (F.col("id") % n).alias("user_id"), F.when(F.col("id") < 20, "view").otherwise("click").alias("event_type"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("value"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.week, r.event_type): r for r in QUERIES["AGG-18"](spark, str(tmp_path)).collect()}
    assert {k: (r.n, r.users, r.most) for k, r in got.items()} == {(w, t): v for w in (-1, 0) for t, v in {"all": (2 * n + 3, n, 3), "view": (20, 20, 1), "click": (2 * n - 17, n, 2)}.items()}
    assert all(r.users_ok and r.median_ok and r.high_ok for r in got.values())


def pairs(df):
    return sorted(map(str, df.collect()))


def tables(spark):
    rng = random.Random(5)
    left = [(rng.choice([0, 0, 0, 1, 2, 3, None, rng.randrange(4000)]), i, "x") for i in range(6000)]
    right = [(k, f"r{k}{j}") for k in [*range(0, 60), None, 5000] for j in range(1 + (k == 1))]
    return spark.createDataFrame(left, "k long, i long, c string").repartition(4), spark.createDataFrame(right, "k long, r string").repartition(2)


def test_buckets_meet_without_a_shuffle(spark):
    left, right = tables(spark)
    a, b = J.bucketed(left, ["k"], 4, "test_left"), J.bucketed(right, ["k"], 4, "test_right")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "k")
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        grouped = a.groupBy("k").count()
        assert "Exchange" not in plan(grouped)
        assert "Exchange" in plan(left.join(right, "k"))
        assert pairs(joined) == pairs(left.join(right, "k")) and pairs(grouped) == pairs(left.groupBy("k").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_grow_in_number_with_the_tables(spark, monkeypatch):
    small, large = spark.range(3), spark.range(1001)
    assert J.buckets_for(small, large) == 8
    monkeypatch.setattr(J, "BUCKET_ROWS", 100)
    assert J.buckets_for(small, large) == J.buckets_for(large, small) == 11


def test_filters_before_a_join_keep_all_partners_and_little_else(spark):
    left, right = tables(spark)
    kept = J.prefiltered(left, right, ["k"])
    joined = left.join(right, "k")
    assert pairs(kept.join(right, "k")) == pairs(joined)
    partners, others = left.join(right, "k", "left_semi").count(), left.dropna(subset=["k"]).join(right, "k", "left_anti").count()
    assert partners <= kept.count() <= partners + 0.05 * others
    before = plan(kept.join(right, "k").select("i", "r"))
    at = min(i for i in (before.find("getbit"), before.find("bit_get")) if i >= 0)
    assert at > before.find("Join") and "BroadcastNestedLoopJoin" in before  # one row, below the join
    most, J.MOST_BITS = J.MOST_BITS, 8
    try:
        assert pairs(J.prefiltered(left, right, ["k"])) == pairs(left.dropna(subset=["k"]))
    finally:
        J.MOST_BITS = most
    assert J.prefiltered(left, right.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_give_the_rows_of_plain_ones(spark, how):
    left, right = tables(spark)
    hot = {r.k: r.parts for r in J.hot_keys(left, ["k"], 500).collect()}
    assert hot[0] >= 4 and 1 in hot and len(hot) < 8
    got = J.salted_join(left, right, ["k"], 500, how)
    assert pairs(got.select("k", "i", "c", "r")) == pairs(left.join(right, "k", how).select("k", "i", "c", "r"))
    with pytest.raises(ValueError, match="no salted outer join"):
        J.salted_join(left, right, ["k"], 500, "outer")


def test_ranks_of_values_have_no_window_over_rows(spark):
    rng = random.Random(2)
    values = [rng.choice([None, 1.0, 2.0, 2.5, rng.random()]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(3)
    got = {r.i: r for r in value_ranks(df, "v").collect()}
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    for i, v in enumerate(values):
        low, upto = order.index(v), len(order) - order[::-1].index(v)
        distinct = len({x for x in order[:low]}) + 1
        assert (got[i]["rank"], got[i].dense_rank) == (low + 1, distinct)
        assert (got[i].percent_rank, got[i].cume_dist) == (pytest.approx(low / 499), pytest.approx(upto / 500))
    assert value_ranks(df.filter("i = 0"), "v").first()["percent_rank"] == 0 and value_ranks(df.limit(0), "v").count() == 0


def test_days_of_23_and_25_hours(spark):
    e = spark.createDataFrame([("2024-03-09 12:00:00",), ("2024-11-04 12:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    hours = {str(r.day): r.hours for r in local_days(e, "ts", "America/New_York").collect()}
    assert hours["2024-03-10"] == 23 and hours["2024-11-03"] == 25 and len(hours) == 241 and set(hours.values()) == {23, 24, 25}
    assert {str(r.day) for r in local_days(e, "ts", "Europe/Berlin").filter("hours = 23").collect()} == {"2024-03-31"}
    assert local_days(e.limit(0), "ts", "UTC").collect() == []

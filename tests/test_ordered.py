"""Chunked ranks, running values and lags equal plain windows, hot and null keys included."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rolloom.plans import ordered as o

ORDER = ["ts", "id"]


def plain():
    return Window.partitionBy("key").orderBy(*ORDER)


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows have one key; some keys are null; times repeat."""
    key = F.when(F.col("id") % 2 == 0, F.lit(1)).when(F.col("id") % 13 == 5, F.lit(None)).otherwise(F.col("id") % 7 + 2)
    return (
        spark.range(6000)
        .select(
            "id",
            key.cast("int").alias("key"),
            F.expr("(id * 7919) % 997").alias("ts"),
            F.expr("CAST((id * 31) % 101 AS DOUBLE)").alias("v"),
        )
        .cache()
    )


def same(df, left, right):
    return df.where(~F.col(left).eqNullSafe(F.col(right))).count() == 0


def test_rank(skewed):
    got = o.grouped_rank(skewed, ["key"], ORDER, o.step_chunk("ts", 16)).withColumn("want", F.row_number().over(plain()))
    assert got.count() == 6000
    assert same(got, "rn", "want")


def test_global_rank_has_no_gaps(skewed):
    hashed = skewed.withColumn("h", o.seeded_hash(3, "id"))
    ranks = o.grouped_rank(hashed, [], ["h", "id"], o.hash_chunk(F.col("h"), 2))
    assert ranks.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first() == (6000, 1, 6000)


@pytest.mark.parametrize("current", [True, False])
def test_running(skewed, current):
    frame = plain().rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    got = o.running(skewed, ["key"], ORDER, o.step_chunk("ts", 50), {k: (k, F.col("v")) for k in kinds}, current)
    for kind, function in kinds.items():
        want = function("v").over(frame)
        if kind == "count":
            got = got.withColumn("count", F.coalesce("count", F.lit(0)))
        assert same(got.withColumn("want", want), kind, "want"), kind


def test_previous_value_keeps_null_values(skewed):
    value = F.when(F.col("id") % 5 != 0, F.col("v"))
    got = o.previous_value(skewed, ["key"], ORDER, o.step_chunk("ts", 10), value, "p")
    assert same(got.withColumn("want", F.lag(value).over(plain())), "p", "want")


def test_trailing_mean_crosses_blocks(skewed):
    got = o.trailing_mean(skewed, ["key"], ORDER, o.step_chunk("ts", 16), F.col("v"), 100, "m")
    assert got.count() == 6000
    keyed = got.where("key IS NOT NULL")
    assert same(keyed.withColumn("want", F.avg("v").over(plain().rowsBetween(-99, 0))), "m", "want")


def test_top_rows(skewed):
    got = o.top_rows(skewed, ["key"], [F.col("v").desc(), F.col("id")], 5)
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("v").desc(), "id"))).where("rank <= 5")
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert got.count() == want.count()


def test_no_window_over_a_whole_key(skewed):
    plan = o.grouped_rank(skewed, ["key"], ORDER, o.step_chunk("ts", 16))._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_key" in plan and "_chunk" in plan.split("row_number() windowspecdefinition(")[1][:40]


def test_row_chunks_follow_the_rows_and_not_the_clock(spark):
    """One job with a million events in one minute beside 2,000 sparse ones."""
    dense = spark.range(1_000_000).select(F.lit(0).alias("job"), F.expr("timestamp_micros(CAST(pmod(id * 7919, 1000003) * 59 AS BIGINT))").alias("ts"))
    sparse = spark.range(2_000).select((F.col("id") % 40 + 1).cast("int").alias("job"), F.expr("timestamp_seconds(id * 86400)").alias("ts"))
    chunked, at = o.row_chunks(dense.unionByName(sparse), ["job"], "ts")
    table = chunked.groupBy("job", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    sizes = [r.n for r in table.where("job = 0").orderBy("at").collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * sum(sizes) / len(sizes) and sum(sizes) == 1_000_000
    assert table.count() < 100
    ordered = [(r.low, r.high) for r in table.where("job = 0").orderBy("at").collect()]
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))
    calm, none = o.row_chunks(sparse, ["job"], "ts")
    assert none is None and calm.columns == ["job", "ts"]


@pytest.mark.parametrize("rows", [7, 100, 2500])
def test_row_chunks_serve_all_helpers(skewed, rows, monkeypatch):
    monkeypatch.setattr(o, "SPLITS", 4)
    df = skewed.withColumn("ts", F.when(F.col("id") % 29 != 0, F.col("ts")))
    chunked, at = o.row_chunks(df, ["key"], "ts", rows=rows)
    got = o.grouped_rank(chunked, ["key"], ORDER, at).withColumn("want", F.row_number().over(plain()))
    assert same(got, "rn", "want") and got.count() == df.count()
    summed = o.running(chunked, ["key"], ORDER, at, {"s": ("sum", F.col("v"))}, False)
    frame = plain().rowsBetween(Window.unboundedPreceding, -1)
    assert same(summed.withColumn("want", F.sum("v").over(frame)), "s", "want")
    assert same(o.previous_value(chunked, ["key"], ORDER, at, F.col("v")).withColumn("want", F.lag("v").over(plain())), "previous", "want")
    biggest = chunked.where("ts IS NOT NULL").groupBy("key", at).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("kinds"))
    assert biggest.where(F.col("n") > rows).where("kinds > 1").count() == 0


def test_no_chunk_means_plain_windows(skewed):
    ranked = o.grouped_rank(skewed, ["key"], ORDER, None).withColumn("want", F.row_number().over(plain()))
    assert same(ranked, "rn", "want")
    means = o.trailing_mean(skewed, ["key"], ORDER, None, F.col("v"), 9, "m")
    assert same(means.withColumn("want", F.avg("v").over(plain().rowsBetween(-8, 0))), "m", "want")
    assert same(o.previous_value(skewed, ["key"], ORDER, None, F.col("v")).withColumn("want", F.lag("v").over(plain())), "previous", "want")
    counted = o.running(skewed, ["key"], ORDER, None, {"n": ("count", F.col("v"))})
    frame = plain().rowsBetween(Window.unboundedPreceding, 0)
    assert same(counted.withColumn("want", F.count("v").over(frame)), "n", "want")


@pytest.mark.parametrize("hashed", [1, 1 << 17])
def test_crowded_keys_are_found(rows, monkeypatch, hashed):
    monkeypatch.setattr(o, "HASHED", hashed)
    df = rows("k int, n int", [(None, i) for i in range(5)] + [(i % 4, i) for i in range(16)])
    assert o.has_crowded_key(df, ["k"], 4) and not o.has_crowded_key(df, ["k"], 5)
    assert not o.has_crowded_key(df.limit(0), ["k"], 1)

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rolloom.llm import mixing, sharding


def shards_of(df, n, size="size"):
    return sharding.assign_shards(df, F.col(size), [F.col("doc_id")], n, partitions=3)


def test_shards_are_contiguous_and_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = docs.select("doc_id", (F.octet_length("text") + 1).alias("size"))
    rows = shards_of(df, 16).orderBy("doc_id").collect()
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(16))
    for part in by.values():
        assert [r.slot for r in part] == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 16) <= largest


def test_shard_edges(rows):
    data = [(None, 5, "a", 9), (None, 5, "b", 9), (1, None, "c", 9), (1, 1000, "d", 9), (2, 0, "e", 9), (2, 0, "e", 9)]
    df = rows("doc_id long, size long, text string, slot long", data)
    found = shards_of(df, 4).collect()
    assert len(found) == 6 and sorted(df.columns + ["shard"]) == sorted(found[0].asDict())
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    zero = shards_of(rows("doc_id long, size long", [(1, 0), (2, 0)]), 4).collect()
    assert {r.shard for r in zero} == {0}
    assert shards_of(rows("doc_id long, size long", []), 4).collect() == []
    with pytest.raises(ValueError):
        shards_of(df, 0)


def test_repeated_rows_spread(rows):
    df = rows("doc_id long, size long", [(7, 10)] * 200)
    found = shards_of(df, 4).collect()
    assert sorted(Counter(r.shard for r in found).values()) == [50, 50, 50, 50]


def test_write_shards(spark, rows, tmp_path):
    df = rows("doc_id long, size long", [(i, i % 7 + 1) for i in range(100)])
    sharding.write_shards(shards_of(df, 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def level_by_hand(sizes, weights, most=3):
    """Targets by cutting and sharing again, as often as it takes."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            total -= out[s]
        left -= over
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 10, "c": 10},
        {"a": 1, "b": 2, "c": 1000, "d": 3, "é": 50, None: 7},
        {"a": 1, "b": 1, "c": 1, "d": 10_000},
        {"a": 0, "b": 5},
        {"a": 0},
        {"z": 5, "Z": 5, "10": 5, "9": 5, "": 1},
    ],
)
def test_targets(rows, sizes):
    df = rows("source string, n long", list(sizes.items()))
    found = {r.source: r.target for r in mixing.source_targets(df, "source", F.col("n")).collect()}
    expected = level_by_hand(sizes, (5, 2, 1))
    assert found.keys() == expected.keys()
    assert all(found[s] == pytest.approx(expected[s]) for s in found)


def test_plan_and_emit(rows):
    data = [(i, "abc"[i % 3] if i % 7 else None, i % 11, 1.5, i) for i in range(3000)]
    df = rows("doc_id long, source string, n long, target double, copies long", data)
    plan = mixing.mix_plan(df, "source", F.col("n"), F.col("doc_id"))
    got = plan.collect()
    assert len(got) == 3000
    taken, target = Counter(), {}
    for r in got:
        assert int(r.rate) <= r.copies <= int(r.rate) + 1 and r.copies <= 3
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(d[2] for d in data))
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)
    again = mixing.mix_plan(df.repartition(5), "source", F.col("n"), F.col("doc_id"))
    assert {r.doc_id: r.copies for r in again.collect()} == {r.doc_id: r.copies for r in got}
    emitted = mixing.emit(plan).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m")).collect()
    assert {r.doc_id: r.n for r in emitted} == {r.doc_id: r.copies for r in got if r.copies}
    assert all(r.m == r.n - 1 for r in emitted)


def test_mix_edges(rows):
    df = rows("doc_id long, source string, n long", [(None, None, None), (1, None, 0), (1, None, 0)])
    got = mixing.mix_plan(df, "source", F.col("n"), F.col("doc_id")).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in got] == [(0, 0, 0.0, 0)] * 3
    empty = rows("doc_id long, source string, n long", [])
    assert mixing.emit(mixing.mix_plan(empty, "source", F.col("n"), F.col("doc_id"))).collect() == []


def test_many_sources_are_joined_by_shuffle(rows, monkeypatch):
    df = rows("doc_id long, source string, n long", [(i, f"s{i % 5}", 3) for i in range(50)])
    wide = {r.doc_id: (r.target, r.copies) for r in mixing.mix_plan(df, "source", F.col("n"), F.col("doc_id")).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    slow = {r.doc_id: (r.target, r.copies) for r in mixing.mix_plan(df, "source", F.col("n"), F.col("doc_id")).collect()}
    assert wide == slow


def test_query_columns(spark):
    from rolloom.llm.queries import op1_byte_shards

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in op1_byte_shards(spark, "/root/testdata/sf0.001").collect():
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))

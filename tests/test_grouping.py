"""Hand-computed cases and properties of grouping, rewards and planning."""

import pytest
from pyspark.sql import functions as F

from rolloom.operators import grouping as g
from rolloom.operators import rewards as rw
from rolloom.operators import sampling as sp
from rolloom.operators.validation import check_group_size

INV = "predictor string, example_id int, teacher_id int, rollout_idx int, inv_idx bigint, text string"


def trace(rows, counts, predictor="p", example=0):
    """One example with the given number of invocations per rollout."""
    data = [(predictor, example, 0, r, i + 1, f"{r}.{i}") for r, n in enumerate(counts) for i in range(n)]
    return rows(INV, data)


def rollouts(rows, n, example=0):
    return rows("example_id int, teacher_id int, rollout_idx int", [(example, 0, r) for r in range(n)])


def members(df):
    found = {}
    for row in df.orderBy("inv_idx", "member").collect():
        found.setdefault(row.inv_idx, []).append(row.text)
    return list(found.values())


def test_rollout_without_invocations_drops_the_example(rows):
    inv = trace(rows, [2, 0, 1])
    assert g.drop_empty(inv, rollouts(rows, 3)).count() == 0
    assert g.drop_empty(trace(rows, [2, 1, 1]), rollouts(rows, 3)).count() == 4


def test_entries_of_an_unlisted_rollout_do_not_complete_an_example(rows):
    inv = trace(rows, [1, 0, 0, 0, 0, 0, 0, 0, 0, 1])  # rollouts 0 and 9; listed are 0 and 1
    assert g.drop_empty(inv, rollouts(rows, 2)).count() == 0


def test_prompt_and_completion_of_short_conversations(rows):
    df = rows("id int, messages array<string>", [(0, []), (1, ["a"]), (2, ["a", "b", "c"])])
    got = {r.id: (r.prompt, r.completion) for r in g.prompt_completion(df).collect()}
    assert got == {0: ([], None), 1: ([], "a"), 2: (["a", "b"], "c")}


def test_truncate(rows):
    assert members(g.to_groups(g.align(trace(rows, [3, 1, 2]), "truncate"))) == [["0.0", "1.0", "2.0"]]


def test_fill_repeats_the_last(rows):
    groups = members(g.to_groups(g.align(trace(rows, [3, 1, 2]), "fill", "max")))
    assert groups == [["0.0", "1.0", "2.0"], ["0.1", "1.0", "2.1"], ["0.2", "1.0", "2.1"]]


def test_random_fill_picks_own_invocations_and_is_reproducible(rows):
    runs = [members(g.to_groups(g.align(trace(rows, [5, 2]), "fill", "randint", 3))) for _ in range(2)]
    assert runs[0] == runs[1]
    assert len(runs[0]) == 5
    assert {m[1] for m in runs[0]} <= {"1.0", "1.1"}


def test_ragged_groups_shrink(rows):
    groups = members(g.to_groups(g.align(trace(rows, [1, 3, 2]), "ragged")))
    assert groups == [["0.0", "1.0", "2.0"], ["1.1", "2.1"], ["1.2"]]


@pytest.mark.parametrize("bounded", [True, False])
def test_padding_cycles_and_keeps_large_groups(rows, bounded):
    df = rows("grp int, member bigint", [(0, 0), (0, 1), (0, 2)] + [(1, i) for i in range(9)])
    padded = g.pad_groups(df.withColumn("who", F.col("member")), ["grp"], 7, bounded=bounded)
    got = [r.who for r in padded.where("grp = 0").orderBy("member").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 0]
    assert padded.where("grp = 1").count() == 9


@pytest.mark.parametrize("bounded", [True, False])
def test_group_ranks_agree(rows, bounded):
    groups = members(g.to_groups(g.align(trace(rows, [2, 2, 2]), "truncate"), bounded))
    assert groups == [["0.0", "1.0", "2.0"], ["0.1", "1.1", "2.1"]]


def test_nesting_refuses_large_groups(rows):
    df = rows("grp int, member bigint, x int", [(0, 0, 5), (0, 1, 6)])
    assert g.nest_groups(df, ["grp"], 2, ["x"]).first().samples == [(0, 5), (1, 6)]
    with pytest.raises(Exception, match="more than 1 samples"):
        g.nest_groups(df, ["grp"], 1, ["x"]).collect()


def test_zero_format_reward_counts_as_none(rows):
    df = rows("failed boolean, fr double, score double", [(True, 0.0, 9.0), (True, None, 9.0), (True, 0.5, 9.0), (False, 0.5, 9.0)])
    got = df.select(g.shaped_score(F.col("failed"), F.col("fr"), F.col("score"), -1).alias("r")).collect()
    assert [r.r for r in got] == [-1.0, -1.0, 0.5, 9.0]


def test_diversity(rows):
    df = rows("grp int, a string, b int", [(0, "x", 1), (0, "x", 1), (1, "x", 1), (1, "x", None)])
    assert {r.grp: r.diverse for r in g.diversity(df, ["grp"], ["a", "b"]).collect()} == {0: False, 1: True}


def test_size_report_verdicts(rows):
    df = rows("grp int", [(0,), (0,), (1,)])
    report = lambda n: g.size_report(g.group_sizes(df, ["grp"], n)).first()
    assert (report(2).under, report(2).over, report(2).verdict) == (1, 0, "ok")
    assert report(1).verdict == "error"
    assert g.size_report(g.group_sizes(df.where("false"), ["grp"], 2)).first().verdict == "no data"
    assert check_group_size(df, ["grp"], 2).collect() == [(1, 1)]


def test_step_zero_falls_back_to_the_score_before_training(rows):
    batches = rows("batch_id int, step int", [(1, 0), (2, 1), (3, 2)])
    scores = rows("step int, score double", [(-1, 0.25), (2, 0.75)])
    failures = rows("step int, format_failures bigint", [(1, 4)])
    got = {r.batch_id: (r.validation_score, r.format_failures) for r in g.attach_metrics(batches, scores, failures).collect()}
    assert got == {1: (0.25, 0), 2: (None, 4), 3: (0.75, 0)}


def test_penalty_may_go_below_zero(rows):
    df = rows("r double, n int", [(1.0, 10), (1.0, 15), (1.0, 25), (-1.0, 15), (0.0, 25)])
    got = [x.v for x in df.select(rw.soft_penalty(F.col("r"), F.col("n"), 10, 20).alias("v")).collect()]
    assert got == [1.0, 0.5, -0.5, -1.0, 0.0]


@pytest.mark.parametrize("bounded", [True, False])
def test_advantages(rows, bounded):
    df = rows("grp int, reward double", [(0, 1.0), (0, 3.0), (1, 2.0), (1, 2.0)])
    scaled = rw.advantages(df, ["grp"], True, bounded=bounded).orderBy("grp", "reward").collect()
    std = 2**0.5
    assert [round(r.advantage, 6) for r in scaled] == [round(-1 / (std + 1e-4), 6), round(1 / (std + 1e-4), 6), 0.0, 0.0]
    sums = rw.advantages(df, ["grp"], False, bounded=bounded).groupBy("grp").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in sums)


def test_single_sample_group_has_no_deviation(rows):
    assert rw.advantages(rows("grp int, reward double", [(0, 1.0)]), ["grp"], True).first().advantage is None


def test_split_is_a_partition(spark):
    got = sp.split(spark.range(100), "id", [("train", 60), ("dev", 10), ("test", 20)], 1)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 60, "dev": 10, "test": 20, None: 10}
    other = sp.split(spark.range(100), "id", [("train", 60)], 2).where("split = 'train'")
    assert got.where("split = 'train'").join(other, "id").count() < 60


def simulate_pads(first, n, k, epochs, full):
    """Least-used id first, ties to the id latest in the first shuffle."""
    used = {i: 0 for i in first}
    pads = []
    for _ in range(epochs):
        for i in used:
            used[i] += 1
        missing = k - n % k if n % k or full else 0
        chosen = []
        for _ in range(missing):
            pick = min(reversed(first), key=lambda i: used[i])
            used[pick] += 1
            chosen.append(pick)
        pads.append(chosen)
    return pads


@pytest.mark.parametrize("n,k,full", [(5, 3, True), (6, 3, True), (6, 3, False), (2, 7, True), (7, 5, True)])
def test_epoch_padding_matches_a_simulation(spark, n, k, full):
    plan = sp.epoch_plan(spark.range(n), "id", k, 4, 9, full).collect()
    epochs = [[r.id for r in sorted((p for p in plan if p.epoch == e), key=lambda p: p.slot)] for e in range(4)]
    first = epochs[0][:n]
    assert [e[n:] for e in epochs] == simulate_pads(first, n, k, 4, full)
    assert all(sorted(e[:n]) == list(range(n)) for e in epochs)
    assert len(epochs[0]) % k == 0
    steps = sp.select_steps(spark.createDataFrame(plan), k, 1000)
    assert all(r["count"] == k for r in steps.groupBy("step").count().collect())


def test_repeat_to(spark):
    assert sp.repeat_to(spark.range(3), 7).count() == 9
    assert sp.repeat_to(spark.range(8), 7).count() == 8


def test_fan_out_needs_an_even_division(spark):
    steps = spark.range(2).select(F.lit(0).alias("step"), F.col("id").alias("place"))
    assert sp.fan_out(steps, 2, 6, 2).count() == 12
    with pytest.raises(ValueError):
        sp.fan_out(steps, 4, 6, 2)


def test_shards_are_disjoint_and_even(rows):
    df = rows("b int, idx int", [(0, i) for i in range(23)] + [(1, i) for i in range(2)])
    got = sp.shard(df, ["b"], "idx", 3, 2, 1)
    sizes = {(r.b, r.rank, r.micro_batch): r["count"] for r in got.groupBy("b", "rank", "micro_batch").count().collect()}
    assert sizes == {(0, r, m): (4 if r < 2 else 3) for r in range(3) for m in range(2)}
    assert got.select("b", "idx").distinct().count() == got.count()


def test_dispatch_uses_every_group_before_repeating(rows):
    groups = rows("grp int", [(i,) for i in range(4)])
    pending = rows("bid int", [(i,) for i in (5, 1, 9, 3, 7, 8, 2, 11, 12, 13)])
    done = rows("bid int", [(5,), (100,)])
    got = sp.dispatch(groups, "grp", pending, done, "bid", 1).orderBy("bid").collect()
    assert [r.bid for r in got] == [1, 2, 3, 7, 8, 9, 11, 12, 13]
    assert sorted(r.grp for r in got[:4]) == [0, 1, 2, 3] == sorted(r.grp for r in got[4:8])


def test_dispatch_without_free_ids(rows):
    groups = rows("grp int", [(1,)])
    ids = rows("bid int", [(1,)])
    assert sp.dispatch(groups, "grp", ids, ids, "bid", 1).count() == 0


@pytest.mark.parametrize("rows_of_a_task", [65536, 3])
def test_traces_are_numbered_whole_unless_long(spark, tmp_path, monkeypatch, rows_of_a_task):
    import datetime as dt

    from rolloom.plans import ordered
    from rolloom.workload import fixtures as fx

    monkeypatch.setattr(ordered, "CHUNK_ROWS", rows_of_a_task)
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    lines = [(o, 5000 * (n % 2), 1, n, 1.0, 1.0, n / 10, 0.0, "A", "F", dt.datetime(2024, 1, 1 + (7 - n) // 2)) for o in (1, 2, None) for n in range(7)]
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    numbered = fx.trace_invocations(spark, str(tmp_path))
    assert ("Join" in numbered._jdf.queryExecution().analyzed().toString()) == (rows_of_a_task == 3)
    assert dict(numbered.dtypes)["inv_idx"] == "bigint"
    got = {(r.example_id, r.rollout_idx): [] for r in numbered.collect()}
    for r in numbered.orderBy("inv_idx").collect():
        got[r.example_id, r.rollout_idx].append((r.inv_idx, r.score))
    order = sorted(range(7), key=lambda n: ((7 - n) // 2, n % 2, n))
    assert got == {(o and o // 4, o and o % 2): [(i + 1, n / 10) for i, n in enumerate(order)] for o in (1, 2, None)}


@pytest.mark.parametrize("rows_of_a_task", [65536, 1])
def test_groups_of_short_and_long_examples(rows, monkeypatch, rows_of_a_task):
    from rolloom.plans import ordered

    monkeypatch.setattr(ordered, "CHUNK_ROWS", rows_of_a_task)
    grouped = g.to_groups(g.align(trace(rows, [3, 1, 2]), "ragged"))
    assert members(grouped) == members(g.to_groups(g.align(trace(rows, [3, 1, 2]), "ragged"), bounded=True))
    assert ("Join" in grouped._jdf.queryExecution().analyzed().toString()) == (rows_of_a_task == 1)

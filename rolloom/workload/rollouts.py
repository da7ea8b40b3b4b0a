"""Queries over rollout groups, traces, rewards and step planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.operators import grouping as g
from rolloom.operators import rewards as rw
from rolloom.operators import sampling as sp
from rolloom.operators.validation import check_group_size, check_traces
from rolloom.workload import fixtures as fx
from rolloom.workload.fixtures import with_sql

QUERIES, ORACLES = {}, {}
FAILURE = -1.5


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _r(column, digits: int = 6):
    return F.round(column, digits)


@query(
    "group_advantages",
    with_sql("rollouts")
    + """, shaped AS (
        SELECT user_id, group_no, event_id,
               CASE WHEN length > 3 AND reward > 0 THEN reward * (1 - (length - 3) / 3.0::DOUBLE) ELSE reward END AS reward
        FROM rollouts),
      stats AS (SELECT user_id, group_no, avg(reward) AS m, stddev_samp(reward) AS s FROM shaped GROUP BY 1, 2)
      SELECT user_id, group_no, event_id, round(reward, 6) AS reward, round((reward - m) / (s + 0.0001), 6) AS advantage
      FROM shaped JOIN stats USING (user_id, group_no)""",
)
def group_advantages(spark, d):
    """Penalty, then scaled group-relative advantages."""
    shaped = fx.rollouts(spark, d).withColumn("reward", rw.soft_penalty(F.col("reward"), F.col("length"), 3, 6))
    scored = rw.advantages(shaped, fx.GROUP, scale=True, bounded=True)
    return scored.select("user_id", "group_no", "event_id", _r("reward").alias("reward"), _r("advantage").alias("advantage"))


@query(
    "training_batches",
    with_sql("rollouts")
    + f""", scored AS (
        SELECT *, CASE WHEN NOT failed THEN reward WHEN format_reward IS NULL OR format_reward = 0 THEN {FAILURE} ELSE format_reward END AS score
        FROM rollouts),
      padded AS (
        SELECT s.* REPLACE (u.slot AS k) FROM (SELECT *, count(*) OVER (PARTITION BY user_id, group_no) AS n FROM scored) s,
          unnest(generate_series(0, 7)) u(slot) WHERE u.slot % n = k),
      shaped AS (
        SELECT *, CASE WHEN length > 3 AND score > 0 THEN score * (1 - (length - 3) / 3.0::DOUBLE) ELSE score END AS final FROM padded),
      advantaged AS (
        SELECT *, (final - avg(final) OVER g) / (stddev_samp(final) OVER g + 0.0001) AS advantage, group_no * 8 + k AS idx,
               count(*) OVER (PARTITION BY user_id) AS total
        FROM shaped WINDOW g AS (PARTITION BY user_id, group_no)),
      ranked AS (SELECT *, idx // ((total + 1) // 2) AS rank FROM advantaged),
      placed AS (
        SELECT *, count(*) OVER (PARTITION BY user_id, rank) // 4 AS size,
               row_number() OVER (PARTITION BY user_id, rank ORDER BY md5('11:' || user_id || ':' || rank || ':' || idx), idx) - 1 AS place
        FROM ranked)
      SELECT user_id, event_id, rank, place // size AS micro_batch, round(final, 6) AS reward, round(advantage, 6) AS advantage
      FROM placed WHERE place < size * 4""",
)
def training_batches(spark, d):
    """What a trainer gets: failure scores, groups filled up, penalty, advantages, ranks and micro-batches."""
    score = g.shaped_score(F.col("failed"), F.col("format_reward"), F.col("reward"), FAILURE)
    full = g.pad_groups(fx.rollouts(spark, d), fx.GROUP, fx.GROUP_SIZE, member="k", bounded=True)
    shaped = (
        full.withColumn("reward", score)
        .withColumn("reward", rw.soft_penalty(F.col("reward"), F.col("length"), 3, 6))
    )
    scored = rw.advantages(shaped, fx.GROUP, scale=True, bounded=True)
    batch = scored.select(
        "user_id", "event_id", (F.col("group_no") * fx.GROUP_SIZE + F.col("k")).alias("idx"), "reward", "advantage"
    )
    return sp.shard(batch, ["user_id"], "idx", 2, 4, 11).select(
        "user_id", "event_id", "rank", "micro_batch", _r("reward").alias("reward"), _r("advantage").alias("advantage")
    )


@query(
    "centred_advantages",
    with_sql("rollouts")
    + """SELECT event_id, round(reward - avg(reward) OVER (PARTITION BY user_id, group_no), 6) AS advantage FROM rollouts""",
)
def centred_advantages(spark, d):
    return rw.advantages(fx.rollouts(spark, d), fx.GROUP, scale=False).select("event_id", _r("advantage").alias("advantage"))


@query(
    "soft_length_penalty",
    with_sql("rollouts")
    + """SELECT event_id, length, round(CASE WHEN length <= 3 OR reward <= 0 THEN reward
           ELSE reward - reward * (length - 3) / 3.0::DOUBLE END, 6) AS reward FROM rollouts""",
)
def soft_length_penalty(spark, d):
    return fx.rollouts(spark, d).select(
        "event_id", "length", _r(rw.soft_penalty(F.col("reward"), F.col("length"), 3, 6)).alias("reward")
    )


@query(
    "reward_statistics",
    with_sql("rollouts")
    + """SELECT user_id, round(avg(m), 6) AS reward, round(avg(s), 6) AS reward_std FROM (
           SELECT user_id, group_no, avg(reward) AS m, stddev_samp(reward) AS s FROM rollouts GROUP BY 1, 2) GROUP BY 1""",
)
def reward_statistics(spark, d):
    stats = rw.reward_stats(fx.rollouts(spark, d), fx.GROUP, ["user_id"])
    return stats.select("user_id", _r("reward").alias("reward"), _r("reward_std").alias("reward_std"))


@query(
    "reward_function_means",
    with_sql("rollouts")
    + """SELECT user_id, name, round(avg(value), 6) AS value FROM (
           SELECT user_id, 'rewards/length' AS name, length::DOUBLE AS value FROM rollouts
           UNION ALL SELECT user_id, 'rewards/valid', CASE WHEN failed THEN 0 ELSE 1 END FROM rollouts) GROUP BY 1, 2""",
)
def reward_function_means(spark, d):
    parts = F.create_map(
        F.lit("reward"), F.col("reward"),
        F.lit("length"), F.col("length").cast("double"),
        F.lit("valid"), F.when(F.col("failed"), 0.0).otherwise(1.0),
    )
    long = fx.rollouts(spark, d).select("user_id", F.explode(parts).alias("reward_name", "value"))
    return rw.reward_means(long, ["user_id"]).select("user_id", "name", _r("value").alias("value"))


@query(
    "group_size_check",
    """SELECT user_id, event_type, count(*) AS size FROM events GROUP BY 1, 2 HAVING count(*) <> 12""",
)
def group_size_check(spark, d):
    """Groups of a user's events of one type that do not hold exactly twelve."""
    return check_group_size(fx.table(spark, d, "events"), ["user_id", "event_type"], 12)


_EXPECTED_TRACES = """
    per_rollout AS (SELECT example_id, teacher_id, rollout_idx, count(*) AS n FROM inv GROUP BY 1, 2, 3),
    per_pair AS (
        SELECT r.example_id, r.teacher_id, count(*) AS rollouts, count(*) FILTER (WHERE p.n IS NULL) AS empties
        FROM all_rollouts r LEFT JOIN per_rollout p USING (example_id, teacher_id, rollout_idx) GROUP BY 1, 2),
    examples AS (SELECT DISTINCT example_id FROM all_rollouts),
    wanted AS (SELECT example_id, t.teacher_id FROM examples CROSS JOIN (VALUES (0), (1), (2)) t(teacher_id))
    SELECT example_id, teacher_id, 'rollout_count' AS issue, coalesce(rollouts, 0) AS amount
    FROM wanted LEFT JOIN per_pair USING (example_id, teacher_id) WHERE coalesce(rollouts, 0) <> 2
    UNION ALL SELECT example_id, teacher_id, 'empty_trace', empties FROM per_pair WHERE empties > 0
    UNION ALL SELECT example_id, teacher_id, 'unknown_predictor', count(*) FROM inv WHERE predictor NOT IN ('A', 'N') GROUP BY 1, 2"""


@query("trace_issues", with_sql("inv") + "," + _EXPECTED_TRACES)
def trace_issues(spark, d):
    """A third teacher without rollouts, empty traces, and a predictor nobody declared."""
    rollouts = fx.trace_rollouts(spark, d)
    predictors = spark.createDataFrame([("A",), ("N",)], "predictor string")
    return check_traces(
        rollouts, fx.traces(spark, d), rollouts.select("example_id").distinct(), [0, 1, 2], predictors, 2
    )


@query(
    "predictor_invocations",
    with_sql("inv") + "SELECT predictor, example_id, teacher_id, rollout_idx, inv_idx, l_partkey, score FROM inv",
)
def predictor_invocations(spark, d):
    return fx.trace_invocations(spark, d)


def _lengths(spark, d):
    return g.trace_lengths(fx.traces(spark, d))


def _complete(spark, d):
    return g.drop_empty(fx.trace_invocations(spark, d), fx.trace_rollouts(spark, d), _lengths(spark, d))


_KEPT = with_sql("inv", "kept")


@query("complete_examples", _KEPT + "SELECT predictor, example_id, teacher_id, rollout_idx, inv_idx, l_partkey FROM kept")
def complete_examples(spark, d):
    return _complete(spark, d).drop("score")


_LENGTHS = """, lens AS (SELECT predictor, example_id, teacher_id, rollout_idx, count(*) AS n FROM kept GROUP BY ALL),
    span AS (SELECT predictor, example_id, min(n) AS lo, max(n) AS hi FROM lens GROUP BY ALL)"""


@query(
    "aligned_truncate",
    _KEPT + _LENGTHS
    + " SELECT kept.* EXCLUDE (score) FROM kept JOIN span USING (predictor, example_id) WHERE inv_idx <= lo",
)
def aligned_truncate(spark, d):
    return g.align(_complete(spark, d), "truncate", lengths=_lengths(spark, d)).drop("score")


@query(
    "aligned_fill_last",
    _KEPT + _LENGTHS
    + """ SELECT l.predictor, l.example_id, l.teacher_id, l.rollout_idx, k.l_partkey, s.slot AS inv_idx
        FROM lens l JOIN span USING (predictor, example_id), unnest(generate_series(1, hi)) s(slot)
        JOIN kept k ON k.predictor = l.predictor AND k.example_id = l.example_id AND k.teacher_id = l.teacher_id
          AND k.rollout_idx = l.rollout_idx AND k.inv_idx = least(s.slot, l.n)""",
)
def aligned_fill_last(spark, d):
    return g.align(_complete(spark, d), "fill", "max", lengths=_lengths(spark, d)).drop("score")


@query(
    "aligned_fill_random",
    _KEPT + _LENGTHS
    + """, slots AS (
        SELECT l.*, s.slot, CASE WHEN s.slot <= l.n THEN s.slot ELSE 1 + ('0x' || substr(md5(concat_ws(':', '7', predictor,
            example_id, teacher_id, rollout_idx, s.slot)), 1, 8))::BIGINT % l.n END AS pick
        FROM lens l JOIN span USING (predictor, example_id), unnest(generate_series(1, hi)) s(slot))
      SELECT l.predictor, l.example_id, l.teacher_id, l.rollout_idx, k.l_partkey, l.slot AS inv_idx
      FROM slots l JOIN kept k ON k.predictor = l.predictor AND k.example_id = l.example_id
        AND k.teacher_id = l.teacher_id AND k.rollout_idx = l.rollout_idx AND k.inv_idx = l.pick""",
)
def aligned_fill_random(spark, d):
    return g.align(_complete(spark, d), "fill", "randint", 7, _lengths(spark, d)).drop("score")


_MEMBER = "row_number() OVER (PARTITION BY predictor, example_id, inv_idx ORDER BY teacher_id, rollout_idx) - 1 AS member"


@query("ragged_groups", _KEPT + f"SELECT kept.* EXCLUDE (score), {_MEMBER} FROM kept")
def ragged_groups(spark, d):
    # Four rollouts per example by construction: a group holds at most four rows.
    return g.to_groups(g.align(_complete(spark, d), "ragged"), bounded=True).drop("score")


def _groups(spark, d):
    # Four rollouts per example by construction: a group holds at most four rows.
    return g.to_groups(g.align(_complete(spark, d), "truncate", lengths=_lengths(spark, d)), bounded=True)


@query(
    "nested_groups",
    _KEPT + _LENGTHS
    + """ SELECT predictor, example_id, inv_idx, string_agg(l_partkey, ' ' ORDER BY teacher_id, rollout_idx) AS members
        FROM kept JOIN span USING (predictor, example_id) WHERE inv_idx <= lo GROUP BY ALL""",
)
def nested_groups(spark, d):
    nested = g.nest_groups(_groups(spark, d), g.GROUP, 4, ["l_partkey"])
    members = F.array_join(F.transform("samples", lambda s: s["l_partkey"].cast("string")), " ")
    return nested.select(*g.GROUP, members.alias("members"))


@query(
    "chat_sample_rewards",
    with_sql("rollouts")
    + f"""SELECT event_id, CASE WHEN failed THEN 'assistant' ELSE 'tool' END AS role,
            CASE WHEN failed THEN 'raw ' || event_id ELSE 'parsed ' || event_id END AS content,
            round(CASE WHEN NOT failed THEN reward WHEN format_reward IS NULL OR format_reward = 0 THEN {FAILURE}
                 ELSE format_reward END, 6) AS reward FROM rollouts""",
)
def chat_sample_rewards(spark, d):
    inv = fx.rollouts(spark, d).select(
        "event_id", "failed", "format_reward", F.col("reward").alias("score"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"))).alias("messages"),
        F.concat(F.lit("raw "), "event_id").alias("completion_text"),
        F.lit("tool").alias("output_role"),
        F.concat(F.lit("parsed "), "event_id").alias("output_text"),
    )
    return g.chat_samples(inv, FAILURE).select(
        "event_id", "completion.role", "completion.content", _r("reward").alias("reward")
    )


@query(
    "padded_groups",
    _KEPT
    + f""", members AS (SELECT kept.*, {_MEMBER} FROM kept),
      sized AS (SELECT *, count(*) OVER (PARTITION BY predictor, example_id, inv_idx) AS n FROM members)
      SELECT predictor, example_id, inv_idx, teacher_id, rollout_idx, l_partkey, s.slot AS member
      FROM sized, unnest(generate_series(0, 5)) s(slot) WHERE s.slot % n = member""",
)
def padded_groups(spark, d):
    ragged = g.to_groups(g.align(_complete(spark, d), "ragged"), bounded=True)
    return g.pad_groups(ragged, g.GROUP, 6, bounded=True).drop("score")


@query(
    "group_diversity",
    _KEPT
    + """SELECT predictor, example_id, inv_idx, count(DISTINCT score) >= 2 AS diverse FROM kept GROUP BY ALL""",
)
def group_diversity(spark, d):
    return g.diversity(g.align(_complete(spark, d), "ragged"), g.GROUP, ["score"])


@query(
    "group_size_report",
    _KEPT
    + """, sizes AS (SELECT predictor, example_id, inv_idx, count(*) AS n FROM kept GROUP BY ALL)
      SELECT predictor, count(*) AS groups, count(*) FILTER (WHERE n < 4) AS under, count(*) FILTER (WHERE n > 4) AS over,
             CASE WHEN count(*) = 0 THEN 'no data' WHEN max(n) > 4 THEN 'error' ELSE 'ok' END AS verdict
      FROM sizes GROUP BY 1 ORDER BY 1""",
)
def group_size_report(spark, d):
    ragged = g.align(_complete(spark, d), "ragged")
    return g.size_report(g.group_sizes(ragged, g.GROUP, 4), ["predictor"])


@query(
    "step_metrics",
    with_sql("rollouts", "scores")
    + """, failures AS (SELECT user_id AS run_id, k AS step, count(*) FILTER (WHERE failed) AS f FROM rollouts GROUP BY 1, 2)
      SELECT b.user_id AS run_id, b.event_id, b.k AS step, round(coalesce(s.score, z.score), 6) AS validation_score,
             coalesce(f.f, 0) AS format_failures
      FROM rollouts b LEFT JOIN (SELECT * FROM scores WHERE step % 3 = 2 OR step = -1) s ON s.run_id = b.user_id AND s.step = b.k
      LEFT JOIN scores z ON z.run_id = b.user_id AND z.step = -1 AND b.k = 0
      LEFT JOIN failures f ON f.run_id = b.user_id AND f.step = b.k""",
)
def step_metrics(spark, d):
    """Steps are places in a group; scores exist for every third step and before training."""
    rollouts = fx.rollouts(spark, d).withColumnRenamed("user_id", "run_id").withColumnRenamed("k", "step")
    scores = fx.validation_scores(spark, d).where("step % 3 = 2 OR step = -1")
    failures = g.format_failures(rollouts, ["run_id", "step"])
    joined = g.attach_metrics(rollouts, scores, failures, ["run_id"])
    return joined.select(
        "run_id", "event_id", "step", _r("validation_score").alias("validation_score"), "format_failures"
    )


@query(
    "format_failure_counts",
    with_sql("rollouts")
    + "SELECT user_id, group_no, count(*) FILTER (WHERE failed) AS format_failures FROM rollouts GROUP BY 1, 2",
)
def format_failure_counts(spark, d):
    return g.format_failures(fx.rollouts(spark, d), fx.GROUP)


@query(
    "predictor_union",
    _KEPT
    + """SELECT CASE predictor WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS predictor_no, predictor, example_id, inv_idx,
           count(*) AS size FROM kept GROUP BY ALL""",
)
def predictor_union(spark, d):
    inv = _complete(spark, d)
    merged = g.union_groups([inv.where(F.col("predictor") == name) for name in ("N", "A", "R")])
    return merged.groupBy("predictor_no", *g.GROUP).agg(F.count(F.lit(1)).alias("size"))


# --- splits and planning ------------------------------------------------------------

SEED = 42


@query(
    "seeded_split",
    """SELECT c_custkey, pos AS position, CASE WHEN pos < 600 THEN 'train' WHEN pos < 900 THEN 'dev' ELSE 'test' END AS split
       FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS pos FROM customer)""",
)
def seeded_split(spark, d):
    ids = fx.table(spark, d, "customer").select("c_custkey")
    return sp.split(ids, "c_custkey", [("train", 600), ("dev", 300), ("test", None)], SEED)


@query(
    "repeated_train_set",
    """SELECT s_suppkey, c.copy FROM supplier, (SELECT count(*) AS n FROM supplier),
         unnest(generate_series(0, greatest((1000 + n - 1) // n, 1) - 1)) c(copy)""",
)
def repeated_train_set(spark, d):
    return sp.repeat_to(fx.table(spark, d, "supplier").select("s_suppkey"), 1000)


_EPOCHS = """
    WITH ids AS (SELECT c_custkey, e.epoch FROM customer, unnest(generate_series(0, 2)) e(epoch)),
    n AS (SELECT count(*) AS n, 7 - count(*) % 7 AS p FROM customer),
    slots AS (
        SELECT epoch, c_custkey, row_number() OVER (PARTITION BY epoch
            ORDER BY md5('42:' || epoch || ':' || c_custkey), c_custkey) - 1 AS slot FROM ids),
    pads AS (
        SELECT t // p AS epoch, n + t % p AS slot, s.c_custkey FROM n, unnest(generate_series(0, 3 * p - 1)) u(t)
        JOIN slots s ON s.epoch = 0 AND s.slot = n - 1 - t % n),
    plan AS (SELECT epoch, slot, c_custkey FROM slots UNION ALL SELECT epoch, slot, c_custkey FROM pads)"""


def _plan(spark, d):
    return sp.epoch_plan(fx.table(spark, d, "customer"), "c_custkey", 7, 3, SEED)


@query("epoch_plan", _EPOCHS + " SELECT epoch, slot, c_custkey FROM plan")
def epoch_plan(spark, d):
    return _plan(spark, d).drop(sp.WIDTH)


_STEPS = _EPOCHS + """, steps AS (
    SELECT c_custkey, epoch, slot, (epoch * (n + p) + slot) // 7 AS step, (epoch * (n + p) + slot) % 7 AS place FROM plan, n)"""


@query("step_examples", _STEPS + " SELECT * FROM steps")
def step_examples(spark, d):
    """All steps of the plan."""
    return sp.select_steps(_plan(spark, d), 7)


@query(
    "rollout_fan_out",
    _STEPS
    + """ SELECT step, c_custkey, t.teacher_id, s.sample, s.sample * 7 + place AS task, place AS example_ind
      FROM steps, unnest(generate_series(0, 1)) t(teacher_id), unnest(generate_series(0, 2)) s(sample)""",
)
def rollout_fan_out(spark, d):
    steps = sp.select_steps(_plan(spark, d), 7)
    return sp.fan_out(steps, 2, 6, 7).select("step", "c_custkey", "teacher_id", "sample", "task", "example_ind")


@query(
    "rank_shards",
    with_sql("user_events")
    + """, sized AS (SELECT user_id, event_id, rn - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS total FROM user_events),
      ranked AS (SELECT *, idx // ((total + 2) // 3) AS rank FROM sized),
      placed AS (
        SELECT *, count(*) OVER (PARTITION BY user_id, rank) // 4 AS size,
               row_number() OVER (PARTITION BY user_id, rank ORDER BY md5('5:' || user_id || ':' || rank || ':' || idx), idx) - 1 AS place
        FROM ranked)
      SELECT user_id, event_id, idx, rank, place // size AS micro_batch FROM placed WHERE place < size * 4""",
)
def rank_shards(spark, d):
    """A user's events are a batch over three ranks and four micro-batches."""
    batch = fx.user_events(spark, d).select("user_id", "event_id", (F.col("rn") - 1).alias("idx"))
    return sp.shard(batch, ["user_id"], "idx", 3, 4, 5)


@query(
    "batch_dispatch",
    """WITH free AS (
         SELECT o_orderkey AS batch_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS j FROM orders WHERE o_orderstatus <> 'F'),
       n AS (SELECT count(*) AS n FROM supplier), m AS (SELECT count(*) AS m FROM free),
       queue AS (
         SELECT s_suppkey, p.perm, row_number() OVER (PARTITION BY p.perm ORDER BY md5('3:' || p.perm || ':' || s_suppkey), s_suppkey) - 1 AS place
         FROM supplier, n, m, unnest(generate_series(0, (m + n - 1) // n - 1)) p(perm))
       SELECT batch_id, s_suppkey, perm AS permutation, place FROM free, n JOIN queue ON perm = j // n AND place = j % n""",
)
def batch_dispatch(spark, d):
    """Orders are pending batch ids, finished ones fulfilled; suppliers stand for groups."""
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), "o_orderstatus")
    groups = fx.table(spark, d, "supplier").select("s_suppkey")
    return sp.dispatch(groups, "s_suppkey", orders, orders.where("o_orderstatus = 'F'"), "batch_id", 3)

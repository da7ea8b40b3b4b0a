"""Queries over token log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.operators import policy as po
from rolloom.workload import fixtures as fx
from rolloom.workload.fixtures import with_sql

QUERIES, ORACLES = {}, {}
LOW, HIGH, DELTA, BETA = 0.2, 0.28, 1.5, 0.04


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query(
    "token_log_softmax",
    """SELECT vec_id, round(embedding[vec_id % 64 + 1]::DOUBLE / 0.7
           - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE / 0.7)))), 6) AS logp FROM embeddings""",
)
def token_log_softmax(spark, d):
    vectors = fx.table(spark, d, "embeddings")
    logits = F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", F.round(po.token_logp(logits, F.col("vec_id") % 64, 0.7), 6).alias("logp"))


_RATIOS = with_sql("token_logps") + """, ratios AS (
    SELECT *, coalesce(exp(logp_new - logp_old), 1) AS ratio FROM toks),
    clipped AS (SELECT *, greatest(0.8, least(1.28, ratio)) AS clipped FROM ratios),
    losses AS (
      SELECT *, exp(logp_ref - logp_new) - (logp_ref - logp_new) - 1 AS kl,
             CASE WHEN least(ratio, 1.5) * advantage < clipped * advantage THEN -least(ratio, 1.5) * advantage ELSE -clipped * advantage END AS plain
      FROM clipped)"""
_KEYS = "rank, seq_id, pos, part"


def _ratios(spark, d):
    return po.ratios(fx.token_logps(spark, d), LOW, HIGH)


@query("importance_ratios", _RATIOS + f" SELECT {_KEYS}, round(ratio, 6) AS ratio, round(clipped, 6) AS clipped FROM clipped")
def importance_ratios(spark, d):
    return _ratios(spark, d).select(
        "rank", "seq_id", "pos", "part", F.round("ratio", 6).alias("ratio"), F.round("clipped", 6).alias("clipped")
    )


@query("token_losses", _RATIOS + f" SELECT {_KEYS}, round(plain, 5) AS loss FROM losses")
def token_losses(spark, d):
    return po.token_loss(_ratios(spark, d), DELTA).select("rank", "seq_id", "pos", "part", F.round("loss", 5).alias("loss"))


@query(
    "kl_estimate",
    _RATIOS
    + """ SELECT round(avg(kl), 6) AS kl FROM (
         SELECT rank, sum(kl * mask) / nullif(sum(mask), 0) AS kl FROM losses GROUP BY 1)""",
)
def kl_estimate(spark, d):
    return po.mean_kl(po.with_kl(fx.token_logps(spark, d))).select(F.round("kl", 6).alias("kl"))


_SEQ = _RATIOS + """, seqs AS (
    SELECT rank, seq_id, sum((plain + 0.04 * kl) * mask) AS l, sum(mask) AS t FROM losses GROUP BY 1, 2)"""
_LOSS_SQL = {
    "grpo": " SELECT rank, round(avg(l / greatest(t, 1)), 6) AS loss FROM seqs GROUP BY 1",
    "bnpo": " SELECT rank, round(sum(l) / greatest(sum(t), 1), 6) AS loss FROM seqs GROUP BY 1",
    "dr_grpo": " SELECT rank, round(sum(l) / (count(*) * 16), 6) AS loss FROM seqs GROUP BY 1",
    "dapo": """ SELECT rank, round(sum(l) / ((SELECT sum(mask) FROM toks) / (SELECT count(DISTINCT rank) FROM toks)::DOUBLE), 6) AS loss
               FROM seqs GROUP BY 1""",
}


def _loss_query(kind):
    @query(f"policy_loss_{kind}", _SEQ + _LOSS_SQL[kind])
    def policy_loss(spark, d):
        # The global counts need only the mask and the rank, not the joined advantages.
        totals = fx.table(spark, d, "lineitem").agg(
            F.count_if(F.col("l_linestatus") == "O").alias("tokens"),
            F.count_distinct(F.col("l_suppkey") % 4).alias("ranks"),
        )
        losses = po.loss(po.token_loss(_ratios(spark, d), DELTA, BETA), kind, 16, totals)
        return losses.select("rank", F.round("loss", 6).alias("loss"))


for _kind in po.LOSS_KINDS:
    _loss_query(_kind)


@query(
    "clip_fractions",
    _RATIOS
    + """, shares AS (
        SELECT rank, sum(CASE WHEN ratio < 0.8 AND advantage < 0 THEN mask ELSE 0 END) / nullif(sum(mask), 0)::DOUBLE AS low,
               sum(CASE WHEN ratio > 1.28 AND advantage > 0 THEN mask ELSE 0 END) / nullif(sum(mask), 0)::DOUBLE AS high,
               sum(CASE WHEN (ratio < 0.8 AND advantage < 0) OR (ratio > 1.28 AND advantage > 0) THEN mask ELSE 0 END) / nullif(sum(mask), 0)::DOUBLE AS region
        FROM ratios GROUP BY 1)
      SELECT round(avg(low), 6) AS low_mean, round(min(low), 6) AS low_min, round(avg(high), 6) AS high_mean,
             round(max(high), 6) AS high_max, round(avg(region), 6) AS region_mean FROM shares""",
)
def clip_fractions(spark, d):
    stats = po.clip_stats(_ratios(spark, d), LOW, HIGH)
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])

"""Queries over rendered, tokenized and padded chats, text metrics and retrieval."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions import text as tx
from rolloom.functions.chat import ChatTemplate
from rolloom.operators import metrics as mt
from rolloom.operators import policy as po
from rolloom.operators import retrieval as rt
from rolloom.operators import rewards as rw
from rolloom.operators import tokens as tk
from rolloom.operators.batches import processed_batches as processed
from rolloom.operators.grouping import assistant_turns, prompt_completion
from rolloom.session import materialize, spread
from rolloom.workload import fixtures as fx

QUERIES, ORACLES = {}, {}

TEMPLATE = ChatTemplate(prefixes={"system": "<|system|>\n"}, suffixes={"tool": "\n"})
SPECIALS = ("<|pad|>", "<|end|>")
PAD, EOS = 0, 1
BATCH = ["batch_no"]
MAX_SEQ_LEN = 700


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _split(spark, d):
    """Conversations as prompt and completion, eight to a batch; one message has an empty prompt."""
    split = prompt_completion(fx.chats(spark, d)).withColumn("completion", F.array("completion"))
    return split.withColumn("batch_no", F.expr("conv_id DIV 8"))


_PREFIX = "CASE WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|' || role || '|>' END"
_SUFFIX = "CASE WHEN role = 'tool' THEN chr(10) ELSE '<|end|>' END"

_CHAT = f"""
    WITH numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    rendered AS (
        SELECT conv_id, conv_id // 8 AS batch_no,
               string_agg(CASE WHEN i < n THEN {_PREFIX} || text || {_SUFFIX} ELSE {_PREFIX} END, '' ORDER BY i) AS prompt_text,
               string_agg(CASE WHEN i = n THEN text || {_SUFFIX} END, '' ORDER BY i) AS completion_text
        FROM numbered GROUP BY conv_id)"""

_TOKENS = _CHAT + r""",
    tokens AS (
        SELECT conv_id, part, t.token, t.pos FROM (
            SELECT conv_id, 'prompt' AS part, regexp_extract_all(prompt_text, '<\|[a-z]+\|>|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS a FROM rendered
            UNION ALL
            SELECT conv_id, 'completion', regexp_extract_all(completion_text, '<\|[a-z]+\|>|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') FROM rendered),
            unnest(a) WITH ORDINALITY t(token, pos)),
    vocab AS (
        SELECT token, CASE token WHEN '<|pad|>' THEN 0 WHEN '<|end|>' THEN 1 ELSE
               1 + row_number() OVER (PARTITION BY token IN ('<|pad|>', '<|end|>') ORDER BY md5(token), token) END AS id, count(*) AS uses
        FROM tokens GROUP BY token),
    ids AS (
        SELECT conv_id, conv_id // 8 AS batch_no, coalesce(list(id ORDER BY pos) FILTER (WHERE part = 'prompt'), []) AS prompt_ids,
               coalesce(list(id ORDER BY pos) FILTER (WHERE part = 'completion'), []) AS full_ids
        FROM tokens JOIN vocab USING (token) GROUP BY conv_id),
    cut AS (
        SELECT conv_id, batch_no, prompt_ids,
               CASE WHEN conv_id % 3 = 0 THEN full_ids[:len(full_ids) - 1] ELSE full_ids END AS completion_ids FROM ids),
    padded AS (
        SELECT conv_id, batch_no,
               list_concat(list_transform(range(pw - len(prompt_ids)), lambda x: 0::BIGINT), prompt_ids) AS prompt_ids,
               list_concat(list_transform(range(pw - len(prompt_ids)), lambda x: 0), list_transform(prompt_ids, lambda x: 1)) AS prompt_mask,
               list_concat(completion_ids, list_transform(range(cw - len(completion_ids)), lambda x: 0::BIGINT)) AS completion_ids,
               list_concat(list_transform(completion_ids, lambda x: 1), list_transform(range(cw - len(completion_ids)), lambda x: 0)) AS completion_mask
        FROM (SELECT *, max(len(prompt_ids)) OVER (PARTITION BY batch_no) AS pw, max(len(completion_ids)) OVER (PARTITION BY batch_no) AS cw FROM cut)),
    masked AS (
        SELECT * REPLACE (CASE WHEN completion_ids[-1] IN (0, 1) THEN completion_mask ELSE list_transform(completion_mask, lambda x: 0) END AS completion_mask)
        FROM padded)"""


def _joined(column: str) -> str:
    return f"array_to_string({column}, ' ') AS {column}"


def _text(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


@query(
    "prompt_completion_split",
    """SELECT conv_id, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE i < n), '') AS prompt, max(text) FILTER (WHERE i = n) AS completion,
         max(role) FILTER (WHERE i = n) AS role
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
       GROUP BY conv_id""",
)
def prompt_completion_split(spark, d):
    return _split(spark, d).select(
        "conv_id",
        F.array_join(F.transform("prompt", lambda m: m["content"]), "|").alias("prompt"),
        F.col("completion")[0]["content"].alias("completion"),
        F.col("completion")[0]["role"].alias("role"),
    )


@query(
    "assistant_turns",
    """SELECT c.conv_id, c.turn, c.text AS completion, count(p.turn) AS prompt_messages
       FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn
       WHERE c.role = 'assistant' GROUP BY ALL""",
)
def every_assistant_turn(spark, d):
    turns = assistant_turns(fx.chats(spark, d))
    return turns.select(
        "conv_id", "turn", F.col("completion.content").alias("completion"), F.size("prompt").alias("prompt_messages")
    )


@query("rendered_chat", _CHAT + " SELECT conv_id, prompt_text, completion_text FROM rendered")
def rendered_chat(spark, d):
    return tk.render_chat(_split(spark, d), TEMPLATE, "prompt").select("conv_id", "prompt_text", "completion_text")


def _texts(spark, d):
    rendered = tk.render_chat(_split(spark, d), TEMPLATE, "prompt")
    parts = F.create_map(F.lit("prompt"), F.col("prompt_text"), F.lit("completion"), F.col("completion_text"))
    return rendered.select("conv_id", F.explode(parts).alias("part", "text"))


def _coded(spark, d):
    return tk.token_dictionary(_texts(spark, d), ["conv_id", "part"], "text")


@query("vocabulary", _TOKENS + " SELECT token, id AS token_id, uses FROM vocab")
def vocabulary(spark, d):
    return tk.build_vocabulary(_coded(spark, d).words, SPECIALS)


def _token_ids(spark, d):
    """Token ids of both texts, as a stored table: what follows reads it more than once."""
    coded = _coded(spark, d)
    ids = tk.token_ids(coded, tk.build_vocabulary(coded.words, SPECIALS))
    both = ids.groupBy("conv_id").agg(
        F.first(F.when(F.col("part") == "prompt", F.col("ids")), True).alias("prompt_ids"),
        F.first(F.when(F.col("part") == "completion", F.col("ids")), True).alias("completion_ids"),
    )
    return materialize(both.withColumn("batch_no", F.expr("conv_id DIV 8")), "token-ids")


@query(
    "token_ids",
    _TOKENS + f" SELECT conv_id, {_joined('prompt_ids')}, array_to_string(full_ids, ' ') AS completion_ids FROM ids",
)
def token_ids(spark, d):
    return _token_ids(spark, d).select("conv_id", _text("prompt_ids"), _text("completion_ids"))


def _padded(spark, d):
    """Every third completion loses its last token, then both sides are padded per batch."""
    ids = F.col("completion_ids")
    cut = F.when(F.col("conv_id") % 3 == 0, F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids)
    left = tk.pad_left(_token_ids(spark, d).withColumn("completion_ids", cut), BATCH, "prompt_ids", PAD, "prompt_mask")
    return tk.pad_right(left, BATCH, "completion_ids", PAD, "completion_mask")


@query("left_padded_prompts", _TOKENS + f" SELECT conv_id, {_joined('prompt_ids')}, {_joined('prompt_mask')} FROM padded")
def left_padded_prompts(spark, d):
    ids = _token_ids(spark, d)
    return tk.pad_left(ids, BATCH, "prompt_ids", PAD, "prompt_mask").select("conv_id", _text("prompt_ids"), _text("prompt_mask"))


@query(
    "right_padded_completions",
    _TOKENS + f" SELECT conv_id, {_joined('completion_ids')}, {_joined('completion_mask')} FROM padded",
)
def right_padded_completions(spark, d):
    return _padded(spark, d).select("conv_id", _text("completion_ids"), _text("completion_mask"))


_FIT = """, joined AS (
    SELECT conv_id, list_concat(prompt_ids, completion_ids) AS input_ids, list_concat(prompt_mask, completion_mask) AS attention_mask FROM padded),
    wide AS (
      SELECT conv_id, list_concat(input_ids, list_transform(range(w - len(input_ids)), lambda x: 0::BIGINT)) AS input_ids,
             list_concat(attention_mask, list_transform(range(w - len(attention_mask)), lambda x: 0)) AS attention_mask, w
      FROM (SELECT *, max(len(input_ids)) OVER (PARTITION BY conv_id // 8) AS w FROM joined))"""


@query(
    "assembled_sequences",
    _TOKENS + _FIT
    + f""" SELECT conv_id, array_to_string(CASE WHEN w > {MAX_SEQ_LEN} THEN input_ids[w - {MAX_SEQ_LEN} + 1:] ELSE input_ids END, ' ') AS input_ids,
             array_to_string(CASE WHEN w > {MAX_SEQ_LEN} THEN attention_mask[w - {MAX_SEQ_LEN} + 1:] ELSE attention_mask END, ' ') AS attention_mask FROM wide""",
)
def assembled_sequences(spark, d):
    """Padded pairs, as wide as the batch needs and MAX_SEQ_LEN allows."""
    return tk.assemble(_padded(spark, d), BATCH, PAD, MAX_SEQ_LEN).select("conv_id", _text("input_ids"), _text("attention_mask"))


def _masked(spark, d):
    return tk.mask_truncated(_padded(spark, d), EOS, PAD)


@query("truncation_mask", _TOKENS + f" SELECT conv_id, {_joined('completion_mask')} FROM masked")
def truncation_mask(spark, d):
    return _masked(spark, d).select("conv_id", _text("completion_mask"))


@query(
    "length_flags",
    _TOKENS
    + """ SELECT conv_id, list_sum(completion_mask)::BIGINT AS completion_length, len(prompt_ids) > 250 AS prompt_too_long,
            len(completion_ids) > 100 AS completion_too_long FROM padded""",
)
def length_flags(spark, d):
    flagged = tk.length_flags(_padded(spark, d), None, 250, 100)
    return flagged.select("conv_id", "completion_length", "prompt_too_long", "completion_too_long")


@query(
    "completion_length_stats",
    _TOKENS
    + """ SELECT batch_no, round(avg(n), 6) AS mean_length, min(n) AS min_length, max(n) AS max_length
          FROM (SELECT batch_no, list_sum(completion_mask)::BIGINT AS n FROM masked) GROUP BY 1""",
)
def completion_length_stats(spark, d):
    stats = mt.length_stats(_masked(spark, d), BATCH)
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@query(
    "tokens_seen",
    _TOKENS
    + """ SELECT batch_no % 2 AS run, batch_no, tokens, sum(tokens) OVER (PARTITION BY batch_no % 2 ORDER BY batch_no)::BIGINT AS num_tokens
          FROM (SELECT batch_no, sum(len(prompt_mask) + len(completion_mask))::BIGINT AS tokens FROM masked GROUP BY 1)""",
)
def tokens_seen(spark, d):
    """Even batches are one run, odd ones another."""
    return mt.tokens_seen(_masked(spark, d).withColumn("run", F.col("batch_no") % 2), ["run"], "batch_no")


@query(
    "terminated_completions",
    _TOKENS
    + """, ended AS (
        SELECT batch_no, list_sum(completion_mask)::BIGINT AS n,
               len(list_filter(list_zip(completion_ids, completion_mask), lambda z: z[1] = 1 AND z[2] = 1)) > 0 AS done FROM masked)
      SELECT batch_no, round(1 - count(*) FILTER (WHERE done) / count(*)::DOUBLE, 6) AS clipped_ratio,
             round(coalesce(avg(n) FILTER (WHERE done), 0), 6) AS mean_terminated_length,
             coalesce(min(n) FILTER (WHERE done), 0) AS min_terminated_length, coalesce(max(n) FILTER (WHERE done), 0) AS max_terminated_length
      FROM ended GROUP BY 1""",
)
def terminated_completions(spark, d):
    stats = mt.terminated_stats(_masked(spark, d), BATCH, EOS)
    return stats.withColumns(
        {c: F.round(c, 6) for c in ("clipped_ratio", "mean_terminated_length")}
    )


_SOFT, _MAXIMUM = 100, 300


@query(
    "processed_batches",
    _CHAT
    + f""", sized AS (
        SELECT conv_id, batch_no, conv_id % 7 - 2.0::DOUBLE AS reward, length(coalesce(prompt_text, '')) AS p, length(completion_text) AS c,
               count(*) OVER w AS n, max(length(coalesce(prompt_text, ''))) OVER w AS pw, max(length(completion_text)) OVER w AS cw
        FROM rendered WINDOW w AS (PARTITION BY batch_no))
      SELECT conv_id, p AS prompt_tokens, pw AS prompt_width, cw AS completion_width, c::INTEGER AS completion_length,
             round(CASE WHEN c > {_SOFT} AND reward > 0 THEN reward * (1 - (c - {_SOFT}) / {_MAXIMUM - _SOFT}.0::DOUBLE) ELSE reward END, 6) AS reward,
             pw > 400 AS prompt_too_long, cw > 200 AS completion_too_long,
             CASE WHEN n < 8 THEN 'under' WHEN n > 8 THEN 'over' ELSE 'ok' END AS size_status
      FROM sized""",
)
def processed_batches(spark, d):
    """Eight conversations make a group; the caller's tokenizer gives a code point per character."""
    samples = _split(spark, d).withColumn("reward", F.col("conv_id") % 7 - F.lit(2.0))
    encode = lambda texts: [[ord(c) for c in t] for t in texts]
    made = processed(samples, BATCH, 8, TEMPLATE, encode, PAD, _SOFT, _MAXIMUM, 400, 200)
    return made.select(
        "conv_id",
        tk.mask_sum("prompt_mask").cast("bigint").alias("prompt_tokens"),
        F.size("prompt_ids").cast("bigint").alias("prompt_width"),
        F.size("completion_ids").cast("bigint").alias("completion_width"),
        "completion_length",
        F.round("reward", 6).alias("reward"),
        "prompt_too_long",
        "completion_too_long",
        "size_status",
    )


# --- from chats to losses ------------------------------------------------------------

_RANKS, _LOW, _HIGH, _DELTA, _BETA = 4, 0.2, 0.28, 1.5, 0.04

# A sampler logged the reference's log-probabilities for whole sequences; the trainer computes its own for what it kept.
_LOSS_ROWS = _TOKENS + _FIT.replace("FROM padded)", "FROM masked)") + f""", kept AS (
      SELECT conv_id, conv_id // 8 AS batch_no, greatest(w - {MAX_SEQ_LEN}, 0) AS first, w - greatest(w - {MAX_SEQ_LEN}, 0) AS n, input_ids, attention_mask
      FROM wide),
    placed AS (SELECT conv_id, batch_no, first, unnest(range(1, n)) AS pos, input_ids, attention_mask FROM kept),
    predicted AS (
      SELECT conv_id, batch_no, pos, first + pos AS place, input_ids[first + pos + 1] AS token, attention_mask[first + pos + 1] AS mask FROM placed),
    judged AS (
      SELECT conv_id, (reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-4) AS advantage
      FROM (SELECT DISTINCT conv_id, conv_id // 8 AS batch_no, (conv_id * 7919) % 11 / 4.0::DOUBLE AS reward FROM conversations)
      WINDOW g AS (PARTITION BY batch_no)),
    toks AS (
      SELECT conv_id, conv_id % {_RANKS} AS rank, pos, token, mask, advantage,
             -((token * 31 + pos * 17) % 97) / 400.0::DOUBLE AS logp_new,
             CASE WHEN conv_id % 7 <> 0 THEN -((token * 29 + pos * 13) % 97) / 400.0::DOUBLE END AS logp_old,
             -((token * 37 + place * 11) % 97) / 400.0::DOUBLE AS logp_ref
      FROM predicted JOIN judged USING (conv_id))"""


def _trained(spark, d):
    """Chats rendered, tokenized, padded, masked, cut, with advantages and log-probabilities: a row per predicted token."""
    made = tk.assemble(_masked(spark, d), BATCH, PAD, MAX_SEQ_LEN)
    rewards = made.select("conv_id", "batch_no", (F.expr("(conv_id * 7919) % 11") / 4.0).alias("reward"))
    scored = rw.advantages(rewards, BATCH, scale=True).select("conv_id", "advantage")
    logged = lambda ids, a, b: F.transform(
        F.slice(ids, F.lit(2), F.size(ids) - 1), lambda t, i: -((t.cast("bigint") * a + (i + 1) * b) % 97) / 400.0
    )
    # the sampler's sequences are as wide as the batch was before the cut
    pads = F.array_repeat(F.lit(PAD), F.col("first_kept") + F.size("input_ids") - F.size("prompt_ids") - F.size("completion_ids"))
    whole = F.concat("prompt_ids", "completion_ids", pads)
    columns = {
        "of_new": logged(F.col("input_ids"), 31, 17),
        "of_old": F.when(F.col("conv_id") % 7 != 0, logged(F.col("input_ids"), 29, 13)),
        "of_ref": logged(whole, 37, 11),
    }
    sequences = made.withColumns(columns).join(scored, "conv_id")
    names = {"logp_new": "of_new", "logp_old": "of_old", "logp_ref": "of_ref"}
    rows = tk.loss_rows(sequences, ["conv_id"], names, ["logp_ref"])
    return rows.withColumn("rank", F.col("conv_id") % _RANKS).withColumn("seq_id", F.col("conv_id"))


@query(
    "chat_loss_rows",
    _LOSS_ROWS
    + " SELECT conv_id, pos, token, mask, round(advantage, 6) AS advantage, round(logp_new, 6) AS logp_new,"
    " round(logp_old, 6) AS logp_old, round(logp_ref, 6) AS logp_ref FROM toks",
)
def chat_loss_rows(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("advantage", "logp_new", "logp_old", "logp_ref")]
    return _trained(spark, d).select("conv_id", "pos", "token", "mask", *rounded)


_LOSS_OF = {
    "grpo": "avg(l / greatest(t, 1))",
    "bnpo": "sum(l) / greatest(sum(t), 1)",
    "dr_grpo": f"sum(l) / (count(*) * {MAX_SEQ_LEN})",
    "dapo": f"sum(l) / ((SELECT sum(list_sum(completion_mask)) FROM masked) / {_RANKS}.0::DOUBLE)",
}


@query(
    "chat_policy_loss",
    _LOSS_ROWS
    + f""", ratios AS (
        SELECT *, coalesce(exp(logp_new - logp_old), 1) AS ratio, exp(logp_ref - logp_new) - (logp_ref - logp_new) - 1 AS kl FROM toks),
      losses AS (
        SELECT rank, conv_id, mask, -least(least(ratio, {_DELTA}) * advantage, greatest({1 - _LOW}, least({1 + _HIGH}, ratio)) * advantage) + {_BETA} * kl AS loss FROM ratios),
      seqs AS (SELECT rank, conv_id, sum(loss * mask) AS l, sum(mask) AS t FROM losses GROUP BY 1, 2) """
    + " UNION ALL ".join(f"SELECT '{kind}' AS kind, rank, round({value}, 6) AS loss FROM seqs GROUP BY rank" for kind, value in _LOSS_OF.items()),
)
def chat_policy_loss(spark, d):
    """All four losses from rendered chats on. Two of them count the tokens of the completions as they were before the cut."""
    losses = po.token_loss(po.ratios(_trained(spark, d), _LOW, _HIGH), _DELTA, _BETA)
    losses = materialize(losses.groupBy("rank", "seq_id").agg(F.sum(F.col("loss") * F.col("mask")).alias("loss"), F.sum("mask").alias("mask")), "sequence-losses")
    tokens = _masked(spark, d).agg(F.sum(tk.mask_sum("completion_mask")).alias("tokens")).withColumn("ranks", F.lit(_RANKS))
    made = [
        po.reduce_losses(losses, kind, MAX_SEQ_LEN, tokens).select(F.lit(kind).alias("kind"), "rank", F.round("loss", 6).alias("loss"))
        for kind in po.LOSS_KINDS
    ]
    return functools.reduce(DataFrame.unionByName, made)


@query(
    "chat_clip_fractions",
    _LOSS_ROWS
    + """, ratios AS (SELECT *, coalesce(exp(logp_new - logp_old), 1) AS ratio FROM toks),
      shares AS (
        SELECT rank, sum(CASE WHEN ratio < 0.8 AND advantage < 0 THEN mask ELSE 0 END) / nullif(sum(mask), 0)::DOUBLE AS low,
               sum(CASE WHEN ratio > 1.28 AND advantage > 0 THEN mask ELSE 0 END) / nullif(sum(mask), 0)::DOUBLE AS high,
               sum(CASE WHEN (ratio < 0.8 AND advantage < 0) OR (ratio > 1.28 AND advantage > 0) THEN mask ELSE 0 END) / nullif(sum(mask), 0)::DOUBLE AS region
        FROM ratios GROUP BY 1)
      SELECT round(avg(low), 6) AS low_mean, round(min(low), 6) AS low_min, round(avg(high), 6) AS high_mean,
             round(max(high), 6) AS high_max, round(avg(region), 6) AS region_mean FROM shares""",
)
def chat_clip_fractions(spark, d):
    stats = po.clip_stats(po.ratios(_trained(spark, d), _LOW, _HIGH), _LOW, _HIGH)
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


# --- text metrics and evaluation ----------------------------------------------------


@query(
    "unique_letter_reward",
    r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '\p{L}'))) AS letters FROM documents""",
)
def unique_letter_reward(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tx.unique_letters(F.col("text")).alias("letters"))


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in fx.LABEL_NAMES.items())
_LABELLED = f"""WITH names(label, name) AS (VALUES {_NAMES}),
    labelled AS (SELECT vec_id, name AS label FROM embeddings JOIN names USING (label)),
    predicted AS (
      SELECT vec_id, l.label AS gold, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN 'refund' ELSE l.label END AS predicted,
             CASE WHEN vec_id % 5 = 0 THEN 'train' ELSE 'validation' END AS split FROM labelled l)"""


def _predicted(spark, d):
    named = rt.decode_labels(fx.labelled(spark, d), fx.LABEL_NAMES, None, [], None)
    predicted = F.when(F.col("vec_id") % 9 == 0, None).when(F.col("vec_id") % 4 == 0, "refund").otherwise(F.col("label"))
    return named.select(
        "vec_id",
        F.col("label").alias("gold"),
        predicted.alias("predicted"),
        F.when(F.col("vec_id") % 5 == 0, "train").otherwise("validation").alias("split"),
    )


@query(
    "exact_match",
    _LABELLED + " SELECT vec_id, CASE WHEN predicted = gold THEN 1.0::DOUBLE WHEN predicted <> gold THEN 0 END AS score FROM predicted",
)
def exact_match(spark, d):
    return _predicted(spark, d).select("vec_id", tx.exact_match(F.col("predicted"), F.col("gold")).alias("score"))


@query(
    "evaluation_scores",
    _LABELLED
    + """ SELECT split, round(avg(CASE WHEN predicted = gold THEN 1 WHEN predicted IS NULL THEN -0.25 ELSE 0 END), 6) AS score
          FROM predicted GROUP BY 1""",
)
def evaluation_scores(spark, d):
    """Train and validation means in one pass; rows without a prediction count as -0.25."""
    metric = tx.exact_match(F.col("predicted"), F.col("gold"))
    return rw.evaluate(_predicted(spark, d), metric, -0.25, ["split"]).withColumn("score", F.round("score", 6))


def _allowed(spark):
    return spark.createDataFrame([("refund",), ("lost_card",), ("top_up_failed",)], "label string")


@query(
    "decoded_labels",
    _LABELLED + " SELECT vec_id, label FROM labelled WHERE label IN ('refund', 'lost_card', 'top_up_failed') ORDER BY vec_id LIMIT 100",
)
def decoded_labels(spark, d):
    """The first hundred of three labels: the limit is the operator's parameter."""
    return rt.decode_labels(fx.labelled(spark, d), fx.LABEL_NAMES, _allowed(spark), ["vec_id"], 100)


@query(
    "all_decoded_labels",
    _LABELLED + " SELECT vec_id, label FROM labelled WHERE label IN ('refund', 'lost_card', 'top_up_failed')",
)
def all_decoded_labels(spark, d):
    return rt.decode_labels(fx.labelled(spark, d), fx.LABEL_NAMES, _allowed(spark), ["vec_id"], None)


@query(
    "first_row_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_row_per_key(spark, d):
    orders = fx.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    firsts = rt.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")
    return firsts.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "distinct_titles",
    r"""SELECT doc_id, len(t) AS facts, len(list_distinct(t)) AS titles, md5(array_to_string(list_sort(list_distinct(t)), ' ')) AS titles_md5
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)""",
)
def distinct_titles(spark, d):
    """Every word of a document is a supporting fact."""
    facts = F.transform(tx.terms(F.col("text")), lambda w: F.struct(w.alias("key"), F.length(w).alias("sentence")))
    docs = fx.table(spark, d, "documents").select("doc_id", facts.alias("facts"))
    titles = tx.distinct_titles(F.col("facts"))
    return docs.select(
        "doc_id",
        F.size("facts").alias("facts"),
        F.size(titles).alias("titles"),
        F.md5(F.array_join(F.array_sort(titles), " ")).alias("titles_md5"),
    )


def _corpus(spark, d):
    docs = spread(fx.table(spark, d, "documents").select("doc_id", "source", "text"))
    titled = docs.select(
        "doc_id",
        F.concat_ws(" ", "source", F.expr("doc_id DIV 2")).alias("title"),
        F.split("text", "\n").alias("text"),
    )
    return rt.build_corpus(titled).select("doc_id", "title", F.col("entry").alias("text"))


_ENTRY = "source || ' ' || (doc_id // 2) || ' | ' || array_to_string(string_split(text, chr(10)), ' ')"


@query("corpus_entries", f"SELECT doc_id, md5({_ENTRY}) AS entry_md5, length({_ENTRY}) AS entry_length FROM documents")
def corpus_entries(spark, d):
    return _corpus(spark, d).select("doc_id", F.md5("text").alias("entry_md5"), F.length("text").alias("entry_length"))


_BM25 = rf"""
    WITH corpus AS (SELECT doc_id, source || ' ' || (doc_id // 2) AS title, text AS body, {_ENTRY} AS entry FROM documents),
    doc_terms AS (SELECT doc_id, regexp_extract_all(lower(entry), '[\p{{L}}\p{{N}}]+') AS t FROM corpus),
    totals AS (SELECT count(*) AS n, avg(len(t)) AS avglen FROM doc_terms),
    tf AS (SELECT doc_id, len(t) AS dl, u.term, count(*) AS tf FROM doc_terms, unnest(t) u(term) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT item_id AS query_id, u.term, count(*) AS qtf
          FROM benchmark, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) u(term) GROUP BY ALL),
    scored AS (
      SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avglen))), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), totals GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5),
    hits AS (SELECT query_id, doc_id, score, rank FROM best JOIN corpus USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, entry ORDER BY rank) = 1)"""


def _hits(spark, d):
    docs = _corpus(spark, d).select("doc_id", "text")
    queries = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rt.bm25_topk(docs, queries, 5)


@query("bm25_search", _BM25 + " SELECT query_id, doc_id, score, rank FROM hits")
def bm25_search(spark, d):
    """The five best documents of every benchmark text."""
    return _hits(spark, d)


_STOPS = "SELECT term FROM (SELECT DISTINCT doc_id, term FROM raw_terms) GROUP BY term HAVING count(*) * 10 > (SELECT count(*) FROM corpus) * 9"
_STEM = "regexp_replace({}, '(?:ing|ed|es|s)$', '')"
_STEMMED = _BM25[: _BM25.index("    doc_terms AS")] + rf"""
    raw_terms AS (SELECT doc_id, u.term FROM corpus, unnest(regexp_extract_all(lower(entry), '[\p{{L}}\p{{N}}]+')) u(term)),
    stops AS ({_STOPS}),
    doc_terms AS (
      SELECT doc_id, coalesce(list({_STEM.format('term')}) FILTER (term NOT IN (SELECT term FROM stops)), []) AS t
      FROM corpus LEFT JOIN raw_terms USING (doc_id) GROUP BY doc_id),""" + _BM25[_BM25.index("    totals AS") : _BM25.index("    q AS")] + rf"""
    q AS (SELECT query_id, {_STEM.format('word')} AS term, count(*) AS qtf FROM (
            SELECT item_id AS query_id, u.word FROM benchmark, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) u(word))
          WHERE word NOT IN (SELECT term FROM stops) GROUP BY ALL),
""" + _BM25[_BM25.index("    scored AS") :]


@query("stemmed_search", _STEMMED + " SELECT query_id, doc_id, score, rank FROM hits")
def stemmed_search(spark, d):
    """Words of nine tenths of all entries are stop words; a table gives every word that ends in ing, ed, es or s its stem."""
    docs = _corpus(spark, d).select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("word"))
    counted = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    stops = counted.where(F.col("n") * 10 > 9 * docs.agg(F.count(F.lit(1))).scalar()).select("word")
    items = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = items.select(F.explode(tx.terms(F.col("text"))).alias("word"))
    stem = F.regexp_replace("word", "(?:ing|ed|es|s)$", "")
    stems = counted.select("word").union(asked).distinct().select("word", stem.alias("stem")).where(F.col("stem") != F.col("word"))
    return rt.bm25_topk(docs, items, 5, stops=stops, stems=stems)


@query(
    "title_recall",
    _BM25
    + """, gold AS (
        SELECT query_id, list_transform([query_id, query_id + 1, query_id], lambda i: source || ' ' || (i // 2)) AS gold
        FROM (SELECT item_id AS query_id FROM benchmark) JOIN documents ON doc_id = query_id),
      found AS (SELECT query_id, list(title) AS titles FROM hits JOIN corpus USING (doc_id) GROUP BY 1)
      SELECT query_id, round(len(list_intersect(list_distinct(gold), coalesce(titles, []))) / 3.0::DOUBLE, 6) AS recall
      FROM gold LEFT JOIN found USING (query_id)""",
)
def title_recall(spark, d):
    """Gold titles (with a repeat) against the titles of the retrieved entries."""
    corpus = _corpus(spark, d)
    # At most five hits per query; of the corpus only ids and titles are read.
    titled = _hits(spark, d).join(corpus.select("doc_id", "title"), "doc_id")
    found = titled.groupBy("query_id").agg(F.collect_list("title").alias("retrieved"))
    items = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "source")
    ids = F.array(F.col("query_id"), F.col("query_id") + 1, F.col("query_id"))
    titles = F.transform(ids, lambda i: F.concat_ws(" ", "source", F.floor(i / 2)))
    gold = items.join(docs, "query_id").select("query_id", titles.alias("gold"))
    empty = F.array().cast("array<string>")
    scored = gold.join(found, "query_id", "left")
    return scored.select(
        "query_id", F.round(tx.title_recall(F.col("gold"), F.coalesce("retrieved", empty)), 6).alias("recall")
    )

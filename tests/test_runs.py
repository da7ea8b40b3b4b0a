"""Tokens, policy diagnostics, metrics, logs and batch ledgers."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from rolloom.functions import names as nm
from rolloom.functions import text as tx
from rolloom.functions.chat import ChatTemplate
from rolloom.operators import lifecycle as lc
from rolloom.operators import metrics as mt
from rolloom.operators import policy as po
from rolloom.operators import retrieval as rt
from rolloom.operators import tokens as tk
from rolloom.plans import ordered
from rolloom.session import scratch_path
from rolloom.streaming.ledger import ROCKSDB, batch_ledger_stream
from rolloom.streaming.sinks import run_available


def test_prompt_and_completion_make_up_the_full_text(rows):
    message = "array<struct<role:string,content:string>>"
    df = rows(f"m {message}, c {message}", [([("system", "s"), ("user", "q")], [("assistant", "a"), ("tool", "t")])])
    template = ChatTemplate(prefixes={"tool": "[tool]"}, suffixes={"user": "\n"})
    got = tk.render_chat(df, template, "m", "c").select("*", template.render(F.concat("m", "c")).alias("full")).first()
    assert got.prompt_text + got.completion_text == got.full
    assert got.prompt_text == "<|system|>s<|end|><|user|>q\n<|assistant|>"
    assert got.completion_text == "a<|end|>[tool]t<|end|>"


def test_tokenize_empty_unknown_and_repeated(rows, spark):
    df = rows("id int, text string", [(1, "a b a , c<|end|>"), (2, ""), (3, "zz a"), (4, None), (5, "a"), (5, "b"), (None, "a")])
    coded = tk.token_dictionary(df.where("id < 3"), ["id"], "text")
    vocab = tk.build_vocabulary(coded.words, ["<|pad|>", "<|end|>"])
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert ids["<|end|>"] == 1 and sorted(v for k, v in ids.items() if k != "<|end|>") == [2, 3, 4, 5]
    assert {r.token: r.uses for r in vocab.collect()} == {"a": 2, "b": 1, ",": 1, "c": 1, "<|end|>": 1}
    expected = [(1, [ids[t] for t in ("a", "b", "a", ",", "c", "<|end|>")]), (2, []), (3, [-1, ids["a"]]), (4, [])]
    expected += [(5, [ids["a"]]), (5, [ids["b"]]), (None, [ids["a"]])]
    for rows_per_block in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_block)
        try:
            got = [(r.id, r.ids) for r in tk.tokenize(df, ["id"], "text", vocab).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(got, key=str) == sorted(expected, key=str)
    nothing = tk.token_dictionary(df.where("false"), ["id"], "text")
    assert nothing.words.count() == nothing.texts.count() == tk.token_ids(nothing, vocab).count() == 0


def test_loss_rows_line_up_behind_a_cut(rows):
    df = rows(
        "seq int, grp int, prompt_ids array<int>, completion_ids array<int>, prompt_mask array<int>, completion_mask array<int>",
        [(1, 0, [0, 5], [7, 8, 9], [0, 1], [1, 1, 1]), (2, 0, [3, 4], [6, 1, 0], [1, 1], [1, 1, 0]), (3, 1, [2], [], [1], [])],
    )
    made = tk.assemble(df, ["grp"], 0, 4).withColumns(
        {
            "advantage": F.col("seq") * 1.5,
            "of_kept": F.expr("transform(slice(input_ids, 2, 9), x -> -0.1D * x)"),
            "of_all": F.expr("transform(slice(concat(prompt_ids, completion_ids), 2, 9), x -> -0.2D * x)"),
            "missing": F.lit(None).cast("array<double>"),
        }
    )
    names = {"logp_new": "of_kept", "logp_ref": "of_all", "logp_old": "missing"}
    got = tk.loss_rows(made, ["seq"], names, ["logp_ref"]).orderBy("seq", "pos").collect()
    assert [(r.seq, r.pos, r.token, r.mask, r.advantage) for r in got] == [
        (1, 1, 7, 1, 1.5), (1, 2, 8, 1, 1.5), (1, 3, 9, 1, 1.5), (2, 1, 6, 1, 3.0), (2, 2, 1, 1, 3.0), (2, 3, 0, 0, 3.0)
    ]
    assert all(r.logp_new == pytest.approx(-0.1 * r.token) and r.logp_ref == pytest.approx(-0.2 * r.token) and r.logp_old is None for r in got)
    short = made.withColumn("of_kept", F.slice("of_kept", 1, 1))
    with pytest.raises(Exception, match="does not fit"):
        tk.loss_rows(short, ["seq"], names, ["logp_ref"]).collect()


def test_caller_tokenizer(rows):
    df = rows("text string", [("ab",), ("",), (None,)])
    encode = lambda texts: [[ord(c) for c in t] for t in texts]
    assert [r.ids for r in tk.tokenize_with(df, "text", encode).collect()] == [[97, 98], [], None]


def test_processed_batches(rows):
    from rolloom.operators.batches import processed_batches

    message = "array<struct<role:string,content:string>>"
    ask = lambda text: [("user", text)] if text else []
    data = [(1, ask("q"), [("assistant", "long answer")], 1.0), (1, [], [("assistant", "x")], 1.0), (2, ask("q"), [("assistant", "long answer")], -1.0)]
    df = rows(f"grp int, prompt {message}, completion {message}, reward double", data)
    encode = lambda texts: [[ord(c) for c in t] for t in texts]
    got = processed_batches(df, ["grp"], 2, ChatTemplate(), encode, 0, 10, 30, None, 15).orderBy("grp", "completion_length").collect()
    short, long, alone = got
    assert [r.size_status for r in got] == ["ok", "ok", "under"]
    assert len(short.completion_ids) == len(long.completion_ids) == long.completion_length > short.completion_length
    assert len(short.prompt_ids) == len(long.prompt_ids) and sum(short.prompt_mask) < sum(long.prompt_mask)
    assert long.reward == pytest.approx(1 - (long.completion_length - 10) / 20) and short.reward == 1.0 and alone.reward == -1.0
    assert long.completion_too_long and not long.prompt_too_long


def test_padding_and_tail_cut(rows):
    df = rows("grp int, prompt_ids array<int>, completion_ids array<int>", [(0, [5], [7, 8, 9]), (0, [5, 6], [7]), (1, [4], [])])
    left = tk.pad_left(df, ["grp"], "prompt_ids", 0, "prompt_mask")
    both = tk.pad_right(left, ["grp"], "completion_ids", 0, "completion_mask")
    got = sorted(map(tuple, both.select("prompt_ids", "prompt_mask", "completion_ids", "completion_mask").collect()))
    assert got == [([0, 5], [0, 1], [7, 8, 9], [1, 1, 1]), ([4], [1], [], []), ([5, 6], [1, 1], [7, 0, 0], [1, 0, 0])]
    cut = tk.assemble(both, [], 0, 4).select("input_ids", "attention_mask").collect()
    assert sorted(map(tuple, cut)) == [([0, 0, 0, 0], [0, 0, 0, 0]), ([5, 7, 8, 9], [1, 1, 1, 1]), ([6, 7, 0, 0], [1, 1, 0, 0])]
    per_group = tk.assemble(both, ["grp"], 0, 4).where("grp = 1").first()
    assert per_group.input_ids == [4]


def test_truncated_completions(rows):
    df = rows("completion_ids array<int>, completion_mask array<int>", [([7, 1], [1, 1]), ([7, 8], [1, 1]), ([1, 0], [1, 0]), ([1, 7], [1, 1])])
    got = [r.completion_mask for r in tk.mask_truncated(df, 1, 0).collect()]
    assert got == [[1, 1], [0, 0], [1, 0], [0, 0]]
    stats = mt.terminated_stats(tk.mask_truncated(df, 1, 0).withColumn("b", F.lit(0)), ["b"], 1).first()
    assert (stats.clipped_ratio, stats.mean_terminated_length, stats.min_terminated_length, stats.max_terminated_length) == (0.5, 1.5, 1, 2)
    none = mt.terminated_stats(df.where("completion_ids[0] = 99").unionByName(df.where("completion_ids[1] = 8")).withColumn("b", F.lit(0)), ["b"], 1).first()
    assert (none.clipped_ratio, none.max_terminated_length) == (1.0, 0)


def test_text_metrics(rows):
    df = rows("t string, gold array<string>, docs array<string>", [("Aa bÉé 1!", ["x", "x", "y"], ["x | a | b", "z"]), ("", [], [])])
    got = df.select(tx.unique_letters(F.col("t")).alias("n"), tx.title_recall(F.col("gold"), F.col("docs")).alias("r")).collect()
    assert [(r.n, r.r) for r in got] == [(3, pytest.approx(1 / 3)), (0, None)]


def test_bm25_against_brute_force(rows):
    texts = ["a b c", "a a d", "b", "a a d", "", "x y z a"]
    docs = rows("doc_id bigint, text string", list(enumerate(texts)))
    queries = rows("query_id int, text string", [(0, "a d d"), (1, "q"), (2, "b")])
    got = {(r.query_id, r.doc_id): (r.score, r.rank) for r in rt.bm25_topk(docs, queries, 3).collect()}
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)

    def score(query, doc):
        total = 0.0
        for term in query.split():
            df, tf = sum(term in w for w in words), words[doc].count(term)
            total += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(words[doc]) / mean))
        return round(total, 6)

    # Documents 1 and 3 have the same text: one hit, though both are among the three best.
    ranked = sorted((-score("a d d", d), d) for d in range(6) if score("a d d", d))
    kept = [(d, i + 1) for i, (_, d) in enumerate(ranked[:3]) if d != 3]
    assert {k[1]: v for k, v in got.items() if k[0] == 0} == {d: (score("a d d", d), i) for d, i in kept}
    assert {k[1] for k in got if k[0] == 2} == {0, 2} and not any(k[0] == 1 for k in got)


def _bm25(docs, queries, k, stops, stems):
    """{query: [(doc, score), ...]} of the k best by scoring every pair."""
    analyze = lambda text: [stems.get(w, w) for w in text.split() if w not in stops]
    words = {d: analyze(t) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for own in words.values():
        for term in set(own):
            df[term] = df.get(term, 0) + 1
    out = {}
    for q, text in queries:
        scores = {}
        for d, own in words.items():
            for term in analyze(text):
                if term in own:
                    tf = own.count(term)
                    idf = math.log(1 + (len(words) - df[term] + 0.5) / (df[term] + 0.5))
                    scores[d] = scores.get(d, 0.0) + idf * tf / (tf + 0.9 * (0.6 + 0.4 * len(own) / mean))
        out[q] = sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("left_out", [0.0, 0.5, 0.95])
def test_bounded_search_misses_nothing(rows, monkeypatch, left_out):
    pick = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    draw = lambda n: " ".join(pick.choices(vocabulary, weights, k=n))
    docs = [(i, draw(pick.choice([3, 10, 30, 200]))) for i in range(300)]
    queries = [(i, draw(pick.choice([1, 4, 12]))) for i in range(25)] + [(90, "w0"), (91, ""), (92, "nowhere"), (93, "w1 w1 w9s")]
    monkeypatch.setattr(rt, "SEED_POSTINGS", 40)
    monkeypatch.setattr(rt, "SEEDS", 2)
    monkeypatch.setattr(rt, "LEFT_OUT", left_out)
    corpus, asked = rows("doc_id int, text string", docs), rows("query_id int, text string", queries)
    plain = _bm25(docs, queries, 4, set(), {})
    stems = {"w9s": "w9", "w2": "w3", "w5": "w40"}
    # w9 stands for itself, and so does w3
    listed = _bm25(docs, queries, 4, {"w0", "w7"}, stems)
    tables = {"stops": rows("word string", [("w0",), ("w7",), ("unused",)]), "stems": rows("word string, stem string", list(stems.items()))}
    for expected, options in ((plain, {}), (listed, tables)):
        got = {}
        for r in rt.bm25_topk(corpus, asked, 4, **options).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.score, r.doc_id))
        texts = dict(docs)
        for q, hits in expected.items():
            shown = []
            for rank, (score, doc) in enumerate(hits, 1):
                if texts[doc] not in {texts[d] for _, _, d in shown}:
                    shown.append((rank, score, doc))
            assert [(r, d) for r, _, d in sorted(got.get(q, []))] == [(r, d) for r, _, d in shown], q
            assert [s for _, s, _ in sorted(got.get(q, []))] == pytest.approx([s for _, s, _ in shown], abs=2e-6)


def test_search_of_empty_tables(rows):
    none = rows("doc_id int, text string", [])
    queries = rows("query_id int, text string", [(1, "a b")])
    assert rt.bm25_topk(none, queries, 3).count() == 0
    assert rt.bm25_topk(rows("doc_id int, text string", [(1, "a")]), queries.where("false"), 3).count() == 0


def test_log_softmax_is_stable(rows):
    df = rows("l array<double>", [([1000.0, 1001.0],)])
    got = df.select(po.token_logp(F.col("l"), F.lit(1), 2.0).alias("p")).first().p
    assert got == pytest.approx(-math.log(1 + math.exp(-0.5)))


TOKENS = "rank int, seq_id int, logp_new double, logp_old double, logp_ref double, advantage double, mask int"


def test_losses_by_hand(rows):
    df = rows(TOKENS, [(0, 0, 0.0, 0.0, 0.0, 2.0, 1), (0, 0, 1.0, 0.0, 0.0, 2.0, 1), (0, 1, 0.0, None, 0.0, -1.0, 1), (0, 1, -1.0, 0.0, 0.0, -1.0, 0), (1, 2, 0.0, 0.0, 1.0, 1.0, 0)])
    scored = po.token_loss(po.ratios(df, 0.2, 0.2))
    losses = [round(r.loss, 6) for r in scored.orderBy("rank", "seq_id", F.desc("logp_new")).collect()]
    assert losses == [-2.4, -2.0, 1.0, 0.8, -1.0]
    by_rank = lambda kind: {r.rank: round(r.loss, 6) for r in po.loss(scored, kind, 10).collect()}
    assert by_rank("grpo") == {0: round((-4.4 / 2 + 1.0) / 2, 6), 1: 0.0}
    assert by_rank("bnpo") == {0: round(-3.4 / 3, 6), 1: 0.0}
    assert by_rank("dr_grpo") == {0: -0.17, 1: 0.0}
    assert by_rank("dapo") == {0: round(-3.4 / 1.5, 6), 1: 0.0}
    with pytest.raises(ValueError):
        po.loss(scored, "other")
    capped = po.token_loss(po.ratios(df, 0.2, 5.0), delta=2.0).where("logp_new = 1").first().loss
    assert capped == -4.0
    # Rank 1 has no unmasked token and is skipped, as a NaN would be.
    assert po.mean_kl(po.with_kl(df)).first().kl == pytest.approx(math.exp(-1) / 3)
    clip = po.clip_stats(po.ratios(df, 0.2, 0.2), 0.2, 0.2).first()
    assert (clip.low_mean, clip.high_mean, clip.region_mean) == (0.0, pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_best_steps(rows):
    df = rows("run int, step int, score double", [(0, -1, 0.5), (0, 0, 0.5), (0, 1, 0.7), (0, 2, 0.6), (0, 3, 0.7), (0, 4, 0.8), (1, 0, 0.1)])
    got = mt.best_steps(df, ["run"], "improvements").where("checkpoint_name IS NOT NULL").orderBy("run", "step").collect()
    assert [(r.run, r.checkpoint_name) for r in got] == [(0, "model_checkpoint_step_2"), (0, "model_checkpoint_step_5"), (1, "model_checkpoint_step_1")]
    assert mt.best_steps(df, ["run"], "none").where("checkpoint_name IS NOT NULL").count() == 0


def test_ledger_of_checkpoints(rows):
    df = rows("job int, checkpoint_name string, global_step int, timestamp double", [(0, "a", 1, 5.0), (0, "a", 2, 9.0), (0, "b", 3, None), (1, "c", 1, None), (1, "d", 2, None)])
    got = {(r.job, r.checkpoint_name): (r.global_step, r.is_last) for r in mt.checkpoint_ledger(df, ["job"]).collect()}
    assert got == {(0, "a"): (2, True), (0, "b"): (3, False), (1, "c"): (1, False), (1, "d"): (2, True)}


def test_log_messages(rows):
    texts = ["plain", 'a | b | {"k": 1}', "a | {bad}", 'x | {"k": 1} ', 'm | {"s": "p | q"}']
    got = [(r.message, r.c) for r in lc.parse_log(rows("message string", [(t,) for t in texts])).select("message", F.to_json("context").alias("c")).collect()]
    # The last text has a bar inside its JSON, so its tail does not parse.
    assert got == [("plain", None), ("a | b", '{"k":1}'), ("a | {bad}", None), (texts[3], None), (texts[4], None)]


def test_prefixes_are_removed_once_in_order(rows):
    df = rows("m string", [("openai/local:x",), ("local:openai/x",), ("huggingface/openai/x",)])
    assert [r[0] for r in df.select(nm.strip_prefixes(F.col("m"))).collect()] == ["x", "openai/x", "openai/x"]


EVENTS = "job_id bigint, batch_id bigint, kind string, ts timestamp, event_id bigint, generation_time double"


def random_events(seed, n, jobs, batches):
    import datetime

    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    data = []
    for i in range(n):
        # Job 0 gets most events; quiet hours let its queue run empty.
        job = 0 if rng.random() < 0.5 else rng.randrange(jobs)
        weights = (6, 3, 1) if i // 150 % 2 == 0 else (1, 6, 2)
        kind = rng.choices(["request", "submit", "get"], weights)[0]
        data.append((job, rng.randrange(batches), kind, start + datetime.timedelta(seconds=37 * (i // 2)), i, float(rng.randrange(100))))
    return data


def simulate(events, limit):
    jobs = {}
    for job, batch, kind, _, _, seconds in events:
        s = jobs.setdefault(job, {"pending": set(), "done": set(), "refused": 0, "times": []})
        if kind == "request" and batch not in s["done"] and batch not in s["pending"]:
            if len(s["pending"]) < limit:
                s["pending"].add(batch)
            else:
                s["refused"] += 1
        elif kind == "submit":
            s["pending"].discard(batch)
            s["done"].add(batch)
            s["times"].append(seconds)
        elif kind == "get":
            s["done"].discard(batch)
    return jobs


@pytest.mark.parametrize("limit,chunk", [(2, 65536), (4, 65536), (40, 65536), (4, 40)])
def test_ledger_matches_a_simulation(rows, limit, chunk, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    events = random_events(limit, 1500, 5, 9)
    want = {j: (sorted(s["pending"]), len(s["done"]), s["refused"]) for j, s in simulate(events, limit).items()}
    got = {r.job_id: (r.pending, r.completed_count, r.refused) for r in lc.batch_ledger(rows(EVENTS, events), limit).collect()}
    assert got == want


def test_streaming_ledger_equals_the_simulation(spark, rows):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = random_events(11, 900, 4, 7)
    source, output, checkpoint = (scratch_path(spark, f"ledger-test-{p}") for p in ("in", "out", "checkpoint"))
    for part in range(3):
        chunk = rows(EVENTS, events[part * 300 : (part + 1) * 300])
        chunk.repartition(4).write.mode("append").parquet(source)
        stream = spark.readStream.schema(chunk.schema).parquet(source)
        run_available(batch_ledger_stream(stream, 3), output, checkpoint, "update")
    last = spark.read.parquet(output).groupBy("job_id").agg(F.max_by(F.struct("pending", "completed_count", "refused", "avg_generation_time"), "events").alias("s"))
    got = {r.job_id: (r.s.pending, r.s.completed_count, r.s.refused, round(r.s.avg_generation_time, 6)) for r in last.collect()}
    want = {
        j: (sorted(s["pending"]), len(s["done"]), s["refused"], round(sum(s["times"][-100:]) / max(len(s["times"][-100:]), 1), 6))
        for j, s in simulate(events, 3).items()
    }
    assert got == want


def simulate_with_expiry(events, limit, seconds):
    import datetime

    jobs, kept = {}, datetime.timedelta(seconds=seconds)
    for job, batch, kind, at, _, _ in events:
        s = jobs.setdefault(job, {"pending": {}, "done": {}, "refused": 0})
        for table in (s["pending"], s["done"]):
            for old in [i for i, t in table.items() if t < at - kept]:
                del table[old]
        if kind == "request" and batch not in s["done"] and batch not in s["pending"]:
            if len(s["pending"]) < limit:
                s["pending"][batch] = at
            else:
                s["refused"] += 1
        elif kind == "submit":
            s["pending"].pop(batch, None)
            s["done"][batch] = at
        elif kind == "get":
            s["done"].pop(batch, None)
    return jobs


def test_streaming_ledger_retires_what_is_old(spark, rows):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = random_events(12, 600, 4, 9)
    start, end = events[0][3], events[-1][3]
    source, output, checkpoint = (scratch_path(spark, f"expiry-test-{p}") for p in ("in", "out", "checkpoint"))

    def arrive(some):
        chunk = rows(EVENTS, some)
        chunk.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(chunk.schema).parquet(source)
        run_available(batch_ledger_stream(stream, 3, expire=900.0), output, checkpoint, "update")

    def last():
        newest = F.max_by(F.struct("pending", "completed_count", "refused"), F.struct("events", "micro_batch")).alias("s")
        return {r.job_id: (r.s.pending, r.s.completed_count, r.s.refused) for r in spark.read.parquet(output).groupBy("job_id").agg(newest).collect()}

    for part in range(3):
        arrive(events[part * 200 : (part + 1) * 200])
    want = {j: (sorted(s["pending"]), len(s["done"]), s["refused"]) for j, s in simulate_with_expiry(events, 3, 900).items()}
    plain = {j: (sorted(s["pending"]), len(s["done"]), s["refused"]) for j, s in simulate(events, 3).items()}
    assert last() == want and want != plain and any(p or n for p, n, _ in want.values())
    # no job but a new one goes on: timers retire the rest once the watermark has passed
    for number in range(2):
        arrive([(99, 1, "get", end + (end - start) * (number + 9), 10_000 + number, 0.0)])
    got = last()
    assert got.pop(99) == ([], 0, 0) and got == {j: ([], 0, refused) for j, (_, _, refused) in want.items()}


def test_replayed_micro_batches_count_once(spark, rows):
    from rolloom.streaming.sinks import latest_version, merge_available

    source, table, checkpoint = (scratch_path(spark, f"merge-test-{p}") for p in ("in", "table", "checkpoint"))
    add = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    for part in range(3):
        rows("k string, n bigint", [("a", 1), ("b", part)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, n bigint").parquet(source)
        merge_available(stream, table, checkpoint, add, add)
        if part == 1:  # lose the record of the last commit: its micro-batch runs again
            for name in ("1", ".1.crc"):
                os.remove(f"{checkpoint.removeprefix('file:')}/commits/{name}")
    assert {r.k: r.n for r in latest_version(spark, table).collect()} == {"a": 3, "b": 3}


def test_merged_tables_are_rewritten_once_a_run(spark, rows):
    from rolloom.streaming.sinks import latest_version, merge_available

    source, table, checkpoint = (scratch_path(spark, f"parts-test-{p}") for p in ("in", "table", "checkpoint"))
    add = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    merges = []
    merge = lambda df: merges.append(1) or add(df)
    for run in range(2):
        for part in range(7):
            rows("k string, n bigint", [("a", 1), (f"b{run}", part)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, n bigint").option("maxFilesPerTrigger", 1).parquet(source)
        merge_available(stream, table, checkpoint, add, merge)
    assert {r.k: r.n for r in latest_version(spark, table).collect()} == {"a": 14, "b0": 21, "b1": 21}
    # every second micro-batch carries earlier ones with it, and each run ends with a version of the whole
    assert len(merges) == 7 + 2
    assert sorted(r.version for r in spark.read.parquet(f"{table}/whole").select("version").distinct().collect()) == [6, 13]


@pytest.mark.parametrize("most,sizes", [(5, [5, 5, 5, 1]), (100, [6, 6, 4])])
def test_slices_are_bounded_and_in_order(rows, monkeypatch, most, sizes):
    from rolloom.workload import streams

    monkeypatch.setattr(streams, "SLICE_ROWS", most)
    times = [None, None, *range(9), 3, 3, 3, 3, 3]
    table = rows("ts int, event_id int, x string", [(t, i, str(i)) for i, t in enumerate(times)])
    slices, runs = [], []
    streams._in_slices(table, lambda part: slices.append(sorted(r.event_id for r in part.collect())), lambda: runs.append(len(slices)))
    order = sorted(range(len(times)), key=lambda i: (times[i] is not None, times[i] or 0, i))
    assert [len(s) for s in slices] == sizes and runs[-1] == len(slices)
    assert slices == [sorted(order[sum(sizes[:k]) : sum(sizes[: k + 1])]) for k in range(len(sizes))]


def test_overdue_stream_meets_no_pairs(spark, rows):
    import datetime as dt

    from rolloom.streaming.overdue import overdue_stream

    source, output, checkpoint = (scratch_path(spark, f"overdue-test-{p}") for p in ("in", "out", "checkpoint"))
    at = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    random_ = random.Random(5)
    moments = sorted(random_.randrange(20_000) for _ in range(600))
    events = [(random_.choice([0, 1, 2**60 + 1, None]), random_.choice([0, 1, None]), random_.choice(["request"] * 3 + ["submit"]), m, 2**60 + i) for i, m in enumerate(moments)]
    events += [(0, 0, "request", None, 1), (0, 0, "submit", None, 2), (9, 0, "request", 20_000, None), (9, 1, "request", 100, 3)]
    late = [e for e in events if e[2] == "request" and e[3] is not None and not any(
        s[2] == "submit" and None not in (s[0], s[1], s[3]) and s[:2] == e[:2] and e[3] <= s[3] <= e[3] + 60 for s in events)]
    closing = [(-1, -1, kind, 90_000, -1) for kind in ("request", "submit")]
    events.sort(key=lambda e: -1 if e[3] is None else e[3])
    schema = "job_id bigint, batch_id int, kind string, ts timestamp, event_id bigint"
    for first in range(0, len(events), 200):
        some = events[first : first + 200] + (closing if first + 200 >= len(events) else [])
        rows(schema, [(j, b, k, at(m), i) for j, b, k, m, i in some]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        columns = ["job_id", "batch_id", "ts", "event_id"]
        found = overdue_stream(*(stream.where(F.col("kind") == kind).select(*columns) for kind in ("request", "submit")), "1 MINUTE", "10 seconds")
        assert "Join" not in found._jdf.queryExecution().analyzed().toString()
        run_available(found, output, checkpoint)
    got = [(r.job_id, r.batch_id, r.requested_at, r.event_id) for r in spark.read.parquet(output).collect() if r.job_id != -1]
    want = [(j, b, at(m), i) for j, b, _, m, i in late]
    assert len(want) > 50 and sorted(map(str, got)) == sorted(map(str, want))


def test_overdue_and_status(rows):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    events = rows(EVENTS, [(0, 1, "request", at(0), 0, 0.0), (0, 1, "submit", at(10), 1, 0.0), (0, 2, "request", at(0), 2, 0.0), (0, 2, "submit", at(11), 3, 0.0), (0, 3, "request", at(95), 4, 0.0), (0, 4, "submit", at(1), 5, 0.0)])
    assert sorted(r.batch_id for r in lc.overdue(events, 10).collect()) == [2, 3]
    assert [r.batch_id for r in lc.overdue(events, 10, F.lit(at(100))).collect()] == [2]
    seen = rows("job_id int, ts int, event_id int, status string", [(0, 1, 1, "a"), (0, 2, 2, "a"), (0, 3, 3, "b"), (0, 4, 4, None), (0, 5, 5, None), (1, 1, 6, "a")])
    assert sorted(r.event_id for r in lc.status_changes(seen).collect()) == [1, 3, 4, 6]
    first = rows("job_id int, ts int, event_id int, status string", [(0, 1, 1, None), (0, 2, 2, None), (0, 3, 3, "unknown"), (0, 4, 4, "a")])
    changes = lc.status_changes(first).orderBy("event_id").collect()
    assert [(r.event_id, r.status, r.previous_status) for r in changes] == [(1, "unknown", None), (4, "a", "unknown")]
    assert lc.queue_limit() == 4 and lc.queue_limit(None, 5) == 10 and lc.queue_limit(3, 5) == 3


def test_unique_prompts_keep_the_first(rows):
    df = rows("step int, sample_id int, prompt string, completion string, reward_name string, value double, pos int",
              [(0, 1, "p", "late", "reward", 1.0, 2), (0, 2, "p", "early", "reward", 2.0, 1), (0, 2, "p", "early", "len", 3.0, 1), (1, 3, "p", "x", "reward", 4.0, 0)])
    got = mt.completions_table(df, ["reward", "len"], ["pos"], True).orderBy("step").collect()
    assert [(r.step, r.completion, r.reward, r.len) for r in got] == [(0, "early", 2.0, 3.0), (1, "x", 4.0, None)]
    assert mt.completions_table(df, ["reward"], ["pos"]).count() == 3


def test_recent_keeps_the_last_rows(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("w"))
    assert sorted(r.id for r in mt.recent(df, ["w"], ["id"], 2).collect()) == [94, 95, 96, 97, 98, 99]

"""Line numbers, formats, validation order, catalog, requests and logs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from rolloom.operators import validation as v
from rolloom.session import scratch_path
from rolloom.sources.jsonl import file_catalog, line_index, parse_lines, read_line_range, scan_jsonl
from rolloom.sources.logs import read_job_logs, write_job_logs
from rolloom.sources.uploads import write_training_file
from rolloom.sources.rollouts import read_rollout_groups, request_samples

OK = {"role": "user", "content": "hi"}


def lines(rows, *texts, file="f"):
    texts = [t if isinstance(t, str) else json.dumps(t) for t in texts]
    return parse_lines(rows("file string, line_no bigint, raw string", [(file, i + 1, t) for i, t in enumerate(texts)]))


def test_line_numbers_over_many_blocks(spark, tmp_path):
    expected = {}
    for name in ("a", "b", "c"):
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            for i in range(1, 2001):
                text = "" if i % 7 == 0 else json.dumps({"i": i, "pad": "x" * (i % 50)})
                f.write(text + "\n")
                if text:
                    expected[(name, i)] = i
    (tmp_path / "ignored.txt").write_text("{}\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        scanned = scan_jsonl(spark, str(tmp_path))
        got = scanned.select("file", "line_no", F.try_variant_get("parsed", "$.i", "int").alias("i")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {(os.path.basename(r.file)[0], r.line_no): r.i for r in got} == expected


def test_line_index_serves_later_scans_and_fails_on_other_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"i": {i}}}\n' for i in range(1, 3001)))
    conf, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(conf, "9000")
    try:
        index = line_index(spark, str(tmp_path))
        assert index.count() > 6 and index.agg(F.sum("lines")).first()[0] == 6000
        scanned = scan_jsonl(spark, str(tmp_path), index=index)
        wrong = F.try_variant_get("parsed", "$.i", "bigint") != F.col("line_no")
        assert scanned.where(wrong).count() == 0 and scanned.count() == 6000
        one = line_index(spark, f"{tmp_path}/a.jsonl", "*")
        (file,) = one.select("file").distinct().first()
        part = read_line_range(spark, one, file, 1490, 1510)
        assert sorted(r.line_no for r in part.collect()) == list(range(1490, 1511)) and part.where(wrong).count() == 0
        spark.conf.set(conf, "7000")
        with pytest.raises(Exception, match="does not fit"):
            scan_jsonl(spark, str(tmp_path), index=index).agg(F.sum("line_no")).collect()
        spark.conf.set(conf, "9000")
        (tmp_path / "b.jsonl").write_text('{"i": 1}\n' * 5000)
        with pytest.raises(Exception, match="does not fit"):
            scan_jsonl(spark, str(tmp_path), index=index).agg(F.sum("line_no")).collect()
    finally:
        spark.conf.set(conf, before)


def _visible(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files if not f.endswith(".crc"))


def test_sink_writes_what_the_catalog_finds(spark, rows, tmp_path):
    texts = ["", "{bad"] + [json.dumps({"input": 1, "preferred_output": i, "non_preferred_output": "é"}) for i in range(50)]
    data = rows("i int, record string", [*enumerate(texts), (99, None)]).repartition(3)
    row = write_training_file(data, str(tmp_path), "pairs", 12, upload="many").first()
    size = sum(len(t.encode()) + 1 for t in [*texts, ""])
    assert (row.id, row.purpose, row.bytes, row.created_at, row.filename, row.format) == ("many", "training", size, 12, "pairs", "dpo")
    names = _visible(tmp_path / "many")
    assert names[-1] == "metadata.json" and len(names) > 2 and not [n for n in names if n.startswith("_")]
    stored = "".join((tmp_path / "many" / n).read_text() for n in names[:-1])
    assert sorted(stored.split("\n")) == sorted([*texts, "", ""])
    assert scan_jsonl(spark, row.path).count() == 51
    write_training_file(data, str(tmp_path / "other"), order_by=["i"], upload="sorted")
    assert (tmp_path / "other" / "sorted" / "data-00000.jsonl").read_text() == "".join(t + "\n" for t in [*texts, ""])

    now = int(time.time())
    none = write_training_file(data.where("false"), str(tmp_path), upload="none").first()
    assert (none.bytes, none.filename, none.format) == (0, "data-00000.jsonl", "unknown") and 0 <= none.created_at - now < 100
    single = data.where("i = 2").coalesce(1)
    write_training_file(single, str(tmp_path), upload="bare")
    meta = tmp_path / "bare" / "metadata.json"
    meta.write_text(json.dumps({k: v for k, v in json.loads(meta.read_text()).items() if k not in ("created_at", "format")}))
    found = {r.id: r for r in file_catalog(spark, str(tmp_path)).collect()}
    assert set(found) == {"many", "none", "bare"} and found["many"] == row
    assert found["bare"].created_at == int(os.stat(tmp_path / "bare" / "data-00000.jsonl").st_mtime)
    assert (found["bare"].format, found["bare"].path[-16:]) == ("unknown", "data-00000.jsonl")


def test_failed_write_leaves_nothing(spark, rows, tmp_path):
    data = rows("record string", [("{}",), ("one\ntwo",), ("{}",)]).repartition(3)
    with pytest.raises(Exception, match="line end"):
        write_training_file(data, str(tmp_path), upload="u")
    assert _visible(tmp_path) == [] and not [d for d in os.listdir(tmp_path / "u")]
    good = data.where("record = '{}'")
    write_training_file(good, str(tmp_path), upload="u")
    before = _visible(tmp_path)
    with pytest.raises(Exception, match="upload already"):
        write_training_file(good, str(tmp_path), upload="u")
    assert _visible(tmp_path) == before


def test_blank_lines_and_broken_lines(rows):
    got = lines(rows, "  \t", "  ", "\x1c", "{bad", ' {"a": 1} ', "3").collect()
    assert [(r.line_no, r.parsed is None) for r in got] == [(4, True), (5, False), (6, False)]


@pytest.mark.parametrize(
    "record,expected",
    [
        ({"messages": []}, "sft"),
        ({"messages": None}, "unknown"),
        ({"messages": "x"}, "unknown"),
        ({"input": None, "preferred_output": None, "non_preferred_output": None}, "dpo"),
        ({"input": 1, "preferred_output": 2}, "unknown"),
        ({"messages": [], "input": 1, "preferred_output": 1, "non_preferred_output": 1}, "sft"),
        ({"messages": 1, "input": 1, "preferred_output": 1, "non_preferred_output": 1}, "dpo"),
        ([1], "unknown"),
        ("x", "unknown"),
    ],
)
def test_record_format(rows, record, expected):
    assert v.with_format(lines(rows, record)).first().format == expected


def test_file_format_skips_broken_and_unknown(rows):
    df = lines(rows, "{bad", {"a": 1}, {"input": 1, "preferred_output": 1, "non_preferred_output": 1}, {"messages": []})
    assert v.file_format(df).first().format == "dpo"
    assert v.file_format(lines(rows, "{bad", {"a": 1})).first().format == "unknown"


def test_consistency(rows):
    df = lines(rows, {"messages": []}, {"messages": [OK]}, file="good").unionByName(lines(rows, {"messages": []}, "{bad", file="broken"))
    expected = rows("file string, expected_format string, present boolean",
                    [("good", "sft", True), ("broken", "sft", True), ("empty", "dpo", True), ("lost", "sft", False)])
    got = {r.file: (r.consistent, r.first_mismatch) for r in v.format_consistency(df, expected).collect()}
    assert got == {"good": (True, None), "broken": (False, 2), "empty": (True, None), "lost": (False, None)}


@pytest.mark.parametrize(
    "record,message",
    [
        ({"messages": []}, None),
        ({"messages": [{**OK, "extra": 1}], "more": 2}, None),
        ("{bad", "Invalid JSON"),
        ([], "Each line must be a JSON object"),
        ({}, "Missing 'messages' field"),
        ({"messages": None}, "'messages' must be an array"),
        ({"messages": [OK, 3]}, "Each message must be an object"),
        ({"messages": [None]}, "Each message must be an object"),
        ({"messages": [{"role": "user"}]}, "Messages must have 'role' and 'content' fields"),
        ({"messages": [{"role": "user", "content": None}]}, "Message 'role' and 'content' must be strings"),
        ({"messages": [{"role": "user", "content": 5}, 3]}, "Message 'role' and 'content' must be strings"),
    ],
)
def test_sft_rules(rows, record, message):
    got = v.validate_sft(lines(rows, record)).collect()
    assert [r.message for r in got] == ([message] if message else [])


def dpo(**changes):
    record = {
        "input": {"messages": [OK], "tools": [], "parallel_tool_calls": True},
        "preferred_output": [OK],
        "non_preferred_output": [OK],
    }
    for key, value in changes.items():
        if key in record:
            record[key] = value
        else:
            record["input"][key] = value
    return record


@pytest.mark.parametrize(
    "record,message",
    [
        (dpo(), None),
        (dpo(input=[]), "Missing or invalid 'input' field"),
        (dpo(messages="x"), "'input.messages' must be a list"),
        (dpo(messages=[1], tools=1), "Each 'message' must be an object"),
        (dpo(messages=[{"role": "a"}]), "Each message must have 'role' and 'content'"),
        (dpo(messages=[{"role": 1, "content": "a"}]), "'role' and 'content' must be strings"),
        (dpo(tools=None), "'input.tools' must be a list"),
        (dpo(parallel_tool_calls=1), "'input.parallel_tool_calls' must be a boolean"),
        (dpo(preferred_output={}, non_preferred_output={}), "'preferred_output' must be a list"),
        (dpo(preferred_output=["x"]), "Each 'preferred_output' message must be an object"),
        (dpo(non_preferred_output=None), "'non_preferred_output' must be a list"),
        (dpo(non_preferred_output=[{"content": "a"}]), "Each non_preferred_output message must have 'role' and 'content'"),
    ],
)
def test_dpo_rules(rows, record, message):
    got = v.validate_dpo(lines(rows, record)).collect()
    assert [r.message for r in got] == ([message] if message else [])


def test_files_report_the_first_bad_line(rows):
    df = lines(rows, {"a": 1}, {"messages": []}, {"messages": [1]}, file="sft").unionByName(
        lines(rows, dpo(), file="dpo")).unionByName(lines(rows, {"a": 1}, file="odd"))
    got = {r.file: (r.format, r.line_no, r.valid) for r in v.validate_files(df).collect()}
    assert got == {"sft": ("sft", 1, False), "dpo": ("dpo", None, True), "odd": ("unknown", None, False)}


def test_catalog_defaults(spark, tmp_path):
    for name, meta, data in (("f1", {"format": "sft", "created_at": 5, "filename": "x"}, "ab\n"), ("f2", {}, "c\n"), ("f3", None, "d\n"), ("f4", {}, None)):
        (tmp_path / name).mkdir()
        if meta is not None:
            (tmp_path / name / "metadata.json").write_text(json.dumps(meta, indent=1))
        if data is not None:
            (tmp_path / name / "data.jsonl").write_text(data)
    got = {r.id: r for r in file_catalog(spark, str(tmp_path)).collect()}
    assert set(got) == {"f1", "f2"}
    assert (got["f1"].format, got["f1"].created_at, got["f1"].filename, got["f1"].bytes) == ("sft", 5, "x", 3)
    assert (got["f2"].purpose, got["f2"].format, got["f2"].filename) == ("training", "unknown", "data.jsonl")
    assert got["f2"].created_at == int(os.stat(tmp_path / "f2" / "data.jsonl").st_mtime)


def test_request_shapes(rows):
    sample = {"messages": [OK], "completion": {"role": "assistant", "content": "a"}, "reward": 1}
    listed = {**sample, "completion": [{"role": "assistant", "content": "b"}, OK], "reward": 0.5}
    df = rows("id int, text string", [(1, json.dumps({"batch": [sample, listed]})), (2, json.dumps({"batch": [[sample], [listed, sample]]}))])
    got = read_rollout_groups(df.select("id", F.parse_json("text").alias("request")), ["id"]).orderBy("id", "group_no", "member").collect()
    assert [(r.id, r.group_no, r.member, len(r.completion), r.reward) for r in got] == [
        (1, 0, 0, 1, 1.0), (1, 0, 1, 2, 0.5), (2, 0, 0, 1, 1.0), (2, 1, 0, 2, 0.5), (2, 1, 1, 1, 1.0)]
    bad = df.limit(1).select("id", F.parse_json(F.lit('{"batch": [{"messages": [], "reward": null}, 3]}')).alias("request"))
    reasons = [r.reason for r in v.validate_rollouts(request_samples(bad, ["id"])).orderBy("member").collect()]
    assert reasons == ["missing completion", "not an object"]


def test_log_extras_override(spark, rows):
    path = scratch_path(spark, "log-test")
    df = rows("timestamp string, level string, job_id string, job_type string, message string, source string, e string",
              [("t", "info", "j", "SFT", "m", "training_log", '{"level": "debug", "n": [1, 2]}'), ("t", "info", "j", "SFT", "plain", "direct_log", None)])
    write_job_logs(df.select("*", F.parse_json("e").alias("extra")), path)
    got = {r.message: r for r in read_job_logs(spark, path).withColumn("extra", F.to_json("extra")).collect()}
    assert (got["m"].level, got["m"].extra) == ("debug", '{"n":[1,2]}')
    assert (got["plain"].level, got["plain"].extra) == ("info", None)


def test_traces_with_issues(rows):
    rollouts = rows("example_id int, teacher_id int, rollout_idx int", [(0, 0, 0), (0, 0, 1), (1, 0, 0)])
    entries = rows("example_id int, teacher_id int, rollout_idx int, predictor string", [(0, 0, 0, "p"), (0, 0, 0, "x"), (1, 0, 0, "p")])
    examples = rows("example_id int", [(0,), (1,), (2,)])
    got = v.check_traces(rollouts, entries, examples, [0], rows("predictor string", [("p",)]), 2).collect()
    assert sorted(map(tuple, got)) == [(0, 0, "empty_trace", 1), (0, 0, "unknown_predictor", 1), (1, 0, "rollout_count", 1), (2, 0, "rollout_count", 0)]

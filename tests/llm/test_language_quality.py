from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloom.llm import language_id as L
from rolloom.llm import quality as Q
from rolloom.llm.queries import op5_language_codes


def test_held_out_accuracy(spark):
    got = op5_language_codes(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("count", [2, 3, 7, 12])
def test_codewords_are_apart(count):
    code = L.codewords(count).astype(int)
    apart = [(code[i] != code[j]).sum() for i in range(count) for j in range(i)]
    assert min(apart) >= (1 if count == 2 else code.shape[1] // 4)


def test_decoding_corrects_a_wrong_bit():
    model = L.from_counts(["a", "b", "c", "d"], np.eye(4, L.BUCKETS) * 1000)
    counts = np.zeros((1, L.BUCKETS), np.int64)
    counts[0, 2] = 5
    wrong = model._replace(weights=model.weights.copy())
    wrong.weights[:, 0] *= -1
    for known in (model, wrong):
        best, score, gap = L.decode(known, counts, counts.sum(1))
        assert known.languages[best[0]] == "c" and 0 < gap[0] <= score[0] <= 1


def test_language_edges(rows):
    train = rows("text string, lang string", [("the house of the", "en"), ("la casa de la", "es"), ("la", None), (None, "es")] * 3)
    model = L.fit(train, "text", "lang")
    assert model.languages == ["en", "es"]
    data = [(1, None, 1), (2, "", 2), (3, "12 %% _", 3), (4, "the of the", 4), (4, "the of the", 4), (5, "de la casa" * 5000, 5)]
    got = [tuple(r) for r in L.predict(rows("doc_id long, text string, score int", data), "text", model).collect()]
    assert [(g[0], g[2]) for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "es")]
    assert all(g[4] and g[3] == 0 for g in got[:3]) and not got[5][4]
    assert got[3] == got[4]
    none = L.fit(train.where("lang = 'x'"), "text", "lang")
    assert {r.lang_pred for r in L.predict(train, "text", none).collect()} == {"und"}
    one = L.fit(train.where("lang = 'es'"), "text", "lang")
    assert {r.lang_pred for r in L.predict(train.where("text <> ''"), "text", one).collect()} == {"es"}
    assert L.predict(train.limit(0), "text", model).collect() == []


def test_held_out_is_crc(rows):
    import zlib

    got = rows("i long", [(i,) for i in range(50)] + [(None,)]).select("i", L.held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 5 == 0) for r in got)


def measures_by_hand(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
    )


def test_measures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    for text in [r.text for r in docs] + [None, "", " \t\n", "a b c d e a b c d e f", "x\n\nx\nx", "\x1f\x85 é", "a " * 5000]:
        assert Q.measures(text) == measures_by_hand(text)


@pytest.mark.parametrize(
    "line, fault",
    [
        ("A sentence that simply ends here.", None), ("Title", None), ("no end in this longer line", "punctuation"),
        ("Home | News | About | Contact", "navigation"), ("Home > News", "navigation"), ("WOW!! BUY!! NOW!! YES!!", "punctuation"),
        ("We use cookies to improve things.", "boilerplate"), ("Released under the MIT License.", "boilerplate"),
        ("De%%% êeux*** ouier### onaiaux%%% ré.", "punctuation"), ("He said: “No.” Then", None), ("Ernd it. thonon ea rest of on", None),
    ],
)
def test_line_rules(line, fault):
    assert Q.line_fault(line) == fault


def test_judge_edges(rows):
    good = "\n".join(f"Word{i} stands{i} here{i} as number{i}." for i in range(10))
    data = [
        (1, None), (2, ""), (3, good), (3, good), (4, good + "\nHome | News | About | Terms"), (5, "Home | News | About\nBlog | Shop | Team\nHelp | Jobs | Press\nOne line of words."),
        (6, "buy now for the best price\n" * 30), (7, (good + "\n") * 2000),
    ]
    df = rows("doc_id long, text string, kept string", [(*d, "clash") for d in data])
    got = [(r.doc_id, r.base_failed, r.kept) for r in Q.judge(df, "text", ["doc_id", "kept"]).collect()]
    assert got == [
        (1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, False, True), (5, False, False), (6, True, False), (7, True, False),
    ]
    cleaned = Q.judge(df.where("doc_id = 4"), "text", ["doc_id"]).first()
    assert cleaned.clean_text == good and cleaned.n_lost_words == 7
    assert Q.judge(df.limit(0), "text", ["doc_id"]).collect() == []

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from rolloom.llm import decontamination as D
from rolloom.llm import language_id, mixing, near_dedup
from rolloom.llm.queries import QUERIES
from rolloom.llm.texts import byte_words

SF = "/root/testdata/sf0.001"


def leaks_by_hand(docs, items):
    """(doc, item) for all pairs where the item's plain words stand in the document as they are."""
    texts = [(i, b" " + b" ".join(D.plain_words(t)) + b" ") for i, t in docs]
    return {(i, j) for j, t in items if D.plain_words(t) for i, s in texts if b" " + b" ".join(D.plain_words(t)) + b" " in s}


def test_finds_every_whole_item(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = D.contaminated(docs, "doc_id", "text", items, "item_id", "text").collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    expected = leaks_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(expected) > 10
    assert expected <= pairs and len(pairs - expected) <= 2
    assert all(r.lcs >= D.PARAPHRASE and r.cosine >= D.COSINE for r in got)


def test_paraphrases_and_edges(spark, rows, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"term{i}" for i in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30) + ". The answer is " + prose(4) + ".") for i in range(12)] + [(50, None), (51, "?!")]
    changed = items[3][1].split()
    for at in range(0, 28, 6):
        changed[at] = f"swapped{at}"
    half = items[4][1].split()[:16]
    docs = [(i, prose(80)) for i in range(40)]
    docs += [
        (100, prose(50) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(50)),
        (101, items[1][1]),
        (102, prose(20) + " " + " ".join(changed) + " " + prose(20)),
        (103, prose(30) + " " + " ".join(half) + " " + prose(30)),
        (104, None), (105, ""), (106, "short"), (None, items[2][1]), (107, items[5][1]), (107, items[5][1]),
        (108, prose(120_000) + " " + items[6][1]),
    ]
    df = rows("doc_id long, text string, item_id long, kind string", [(*d, 9, "k") for d in docs])
    queries = rows("item_id long, text string, doc_id long", [(*i, 9) for i in items])
    expected = Counter([(100, 0), (101, 1), (102, 3), (None, 2), (107, 5), (107, 5), (108, 6)])
    found = D.contaminated(df, "doc_id", "text", queries, "item_id", "text").collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == expected
    monkeypatch.setattr(D, "ITEM_BLOCK", 5)
    found = D.contaminated(df, "doc_id", "text", queries, "item_id", "text").collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == expected
    assert D.contaminated(df.limit(0), "doc_id", "text", queries, "item_id", "text").collect() == []
    assert D.contaminated(df, "doc_id", "text", queries.limit(0), "item_id", "text").collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert D.common_subsequence([x.encode() for x in a], [y.encode() for y in b]) == table[-1, -1]


def test_factorisation_finds_the_span(rows):
    topics = [[f"t{k}w{i}" for i in range(20)] for k in range(4)]
    rng = random.Random(2)
    texts = [" ".join(rng.choice(topics[i % 4]) for _ in range(40)) for i in range(200)]
    passages = [D.features(D.plain_words(t)) for t in texts]
    idf = np.ones(D.FEATURES, np.float32)
    dense = np.stack([np.bincount(p, minlength=D.FEATURES) for p in passages]).astype(float)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    right = np.linalg.svd(dense, full_matrices=False)[2][:4]
    items = [D.Item(i, D.plain_words(t), []) for i, t in enumerate(texts[:8])]
    found = D.factorise(rows("text string", [(t,) for t in texts]), "text", items, idf, 200)
    assert found.shape == (D.FEATURES, D.RANK)
    assert np.allclose(found.T @ found, np.eye(D.RANK), atol=1e-3)
    assert np.linalg.norm(right @ found) ** 2 > 3.9  # of 4: the span holds the leading directions


def test_factorisation_takes_all_documents(rows, monkeypatch):
    monkeypatch.setattr(D, "SAMPLE", 5, raising=False)
    texts = [" ".join(f"t{k}w{(i + j) % 20}" for j in range(40)) for k in range(12) for i in range(15)]
    idf = np.ones(D.FEATURES, np.float32)
    dense = np.stack([np.bincount(D.features(D.plain_words(t)), minlength=D.FEATURES) for t in texts]).astype(float)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    right = np.linalg.svd(dense, full_matrices=False)[2][:12]
    items = [D.Item(0, D.plain_words(texts[0]), [])]
    found = D.factorise(rows("text string", [(t,) for t in [*texts, "", None]]), "text", items, idf, len(texts))
    assert np.linalg.norm(right @ found) ** 2 > 11.9  # of 12: each topic, though the one item has only its own


def test_texts_are_split_once_before_the_search(spark, rows, monkeypatch):
    texts = ["one two three two", "four, five five", "", None, "?!", "one " * 70_000 + "six"]
    df = rows("doc_id long, text string", list(enumerate(texts))).coalesce(1)
    items = rows("item_id long, text string", [(0, "a phrase that no text has. At all.")])
    seen, whole = spark.sparkContext.accumulator(0), D.plain_words

    def counting(text):
        seen.add(1)
        return whole(text)

    # tasks get this one by value in functions that live in others; the search itself, a function of the module, has its own
    monkeypatch.setattr(D, "plain_words", counting)
    assert D.contaminated(df, "doc_id", "text", items, "item_id", "text").collect() == []
    assert seen.value == 5 + 5  # the texts that are not null, and the item on the driver: whole, its sentences and its answer


def test_stored_counts_give_the_sums_of_the_texts(rows):
    texts = ["one two three two", "four, five five", "", None, "?!", "one " * 70_000 + "six"]
    df = rows("text string", [(t,) for t in texts])
    split = [D.features(words) for words in map(D.plain_words, texts) if words]
    expected = Counter(w for found in split for w in set(found.tolist()))
    frequency, documents = D.document_frequencies(df, "text")
    assert documents == 3 and Counter({int(w): int(frequency[w]) for w in np.flatnonzero(frequency)}) == expected
    counts = [(np.frombuffer(r.at, np.uint16), np.frombuffer(r.times, np.uint32)) for r in D.word_counts(df, "text").collect()]
    whole = Counter(tuple(zip(at.tolist(), times.tolist())) for at, times in counts)
    assert whole == Counter(tuple(sorted(Counter(found.tolist()).items())) for found in split)


def test_answer_of():
    assert D.answer_of("One two three. Four five.") == [b"four", b"five"]
    assert D.answer_of("a b c d e f") == [b"e", b"f"]
    assert D.answer_of("?") == []


def pipeline_by_hand(rows, items, predicted):
    """Ids after each filtering stage, with the operators' small parts on all pairs."""
    from test_near_dedup import classes_by_hand

    left = [(i, t) for i, t in rows if predicted[i]]
    classes = classes_by_hand(left)
    left = [(i, t) for i, t in left if classes[(False, i, t)] == i]
    leaked = {i for i, _ in leaks_by_hand(left, items)}
    return {i for i, _ in left if i not in leaked}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = pipeline_by_hand(rows, items, {i: language_id.has_letter(t) for i, t in rows})
    sizes = {i: len(byte_words(t)) for i, t in rows}
    before = [d for d in docs.collect() if d.doc_id in kept]
    plan = mixing.mix_plan(
        spark.createDataFrame(before, docs.schema), "source", corpus_pipeline.word_count(corpus_pipeline.F.col("text")), corpus_pipeline.F.col("doc_id")
    )
    copies = {r.doc_id: r.copies for r in plan.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    assert [r.shard for r in sorted(got, key=lambda r: (r.doc_id, r.shard))] == sorted(r.shard for r in got)
    assert sum(sizes[r.doc_id] for r in got) > 0


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage_edges(spark, rows, number):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [
        (1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "some words here and there " * 4, "en", "a", 1),
        (None, "otras palabras de la casa", "es", "b", 1), (4, "w " * 50_000, None, "a", 5),
    ]
    name, stage = corpus_pipeline.STAGES[number]
    result = stage(spark, rows(schema, data), SF)
    if number < len(corpus_pipeline.STAGES) - 1:
        assert result.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    result.collect()
    assert stage(spark, rows(schema, []), SF).collect() == []


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES) - 1))
def test_clashing_columns_keep_their_values(rows, spark, number):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, lang_pred string, copies int, digest string"
    words = [f"some words here and there number {i} of a longer text with more in it" for i in range(6)]
    data = [(i, f"{w} {w[::-1]}", "en", "a", 1, 7.5, 99, "mine", -3, "d") for i, w in enumerate(words)]
    result = corpus_pipeline.STAGES[number][1](spark, rows(schema, data), SF)
    assert result.columns == [c.split()[0] for c in schema.split(", ")]
    found = result.collect()
    assert found and all(tuple(r) in data for r in found)


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert near_dedup.SHINGLE == 5 and near_dedup.SIMILAR == 0.8

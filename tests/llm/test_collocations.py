import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolloom.llm.collocations import BREAK, Block, collocations, parse, phrase_counts, tokens

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def grams(rows, most):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for words in words_of(text):
            for size in range(1, most + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts


def brute(rows, least=10, most=3, percent=50, top=2000):
    out = []
    for lang, f in grams(rows, most).items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        inside = {}
        for w, a in candidates.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    part = w[i : i + size]
                    inside[part] = max(inside.get(part, 0), a)
        found = []
        for w, a in candidates.items():
            if 100 * inside.get(w, 0) >= percent * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def run(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations(df, "text", "lang", **options).collect())


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    found = run(docs, parts=5, min_count=4)
    assert found == brute(rows, 4)
    assert len(found) > 300


def test_edges(rows):
    hot = "New York City, new york city; old\ttown\x0bNEW YORK " * 3
    long = "again and " * 9000 + "over there"
    data = [("en", hot, 1)] * 7 + [
        (None, hot, 2), ("und", "new york", 3), ("en", None, 4), ("en", "", 5), ("en", " \t.\n", 6), ("fr", long, 7),
        ("fr", "ÉTÉ été É. été été É", 8), (None, None, 9),
    ]
    df = rows("lang string, text string, phrase long", data)
    for least, most in ((2, 3), (1, 2), (2, 4)):
        found = run(df, min_count=least, max_words=most, parts=3)
        assert found == brute([r[:2] for r in data], least, most) and found
    assert run(df, min_count=2, top=2) == brute([r[:2] for r in data], 2, top=2)
    counts = {(r.lang, r.phrase): r.n for r in phrase_counts(df, "text", "lang", 1).collect()}
    assert counts["fr", "again and"] == 9000 and counts["fr", ""] == 18008


def test_ties_follow_the_bytes_of_the_phrase(rows):
    data = [("en", f"{a} {b}") for a, b in (("é", "y"), ("z", "a"), ("ｚ", "b"), ("😀", "c")) for _ in range(3)]
    df = rows("lang string, text string", data)
    found = run(df, min_count=3)
    assert found == brute(data, 3) and [r[2] for r in found] == ["z a", "é y", "ｚ b", "😀 c"]


def test_empty_table(rows):
    assert run(rows("lang string, text string", [])) == []
    assert run(rows("lang string, text string", [("en", None)])) == []


def test_counts_beyond_64_bits(rows):
    """The score of a phrase found a times where a * a * 1000000 passes 64 bits."""
    import rolloom.llm.collocations as module

    a = 6_000_000_007
    kept = module.materialize
    counts = [("en", "", 9 * a), ("en", "x", a + 1), ("en", "y", a + 3), ("en", "x y", a)]
    try:
        module.materialize = lambda df, label: rows("lang string, phrase string, n long", counts)
        (row,) = collocations(rows("lang string, text string", []), "text", "lang").collect()
    finally:
        module.materialize = kept
    assert row.score == 10**6 * a * a // ((a + 1) * (a + 3))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab .\t\nÉ", max_size=40), max_size=5), st.integers(1, 4), st.integers(1, 3), st.integers(1, 5))
def test_chunks_own_each_ngram_once(texts, tail, trigger, longest):
    chunks = [c for t in texts for c in parse(t.encode(), tail, trigger, longest)]
    if not chunks:
        return
    block = Block(["x"] * len(chunks), chunks, [1] * len(chunks), tail)
    hashes, _ = block.hashed()
    found = {(w, n) for _, spelled, counts in block.counted(hashes) for w, n in zip(spelled, counts.tolist())}
    expected = grams([("x", t) for t in texts], tail + 1).get("x", {})
    assert found == {(" ".join(w).encode(), n) for w, n in expected.items()}


def test_equal_passages_give_equal_chunks():
    passage = b" ".join(b"w%d" % (i * i % 997) for i in range(400))
    one, two = parse(b"some words before " + passage, 2), parse(b"quite other. " + passage + b" after", 2)
    assert len(set(one) & set(two)) > 0.7 * len(one)
    assert tokens(b"A b.\tC", 2) == [b"a", b"b", BREAK, b"c", BREAK, BREAK]


@pytest.mark.parametrize("text", [b"", b" \t", b"...\n"])
def test_texts_without_words(text):
    assert parse(text, 2) == []

import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolloom.llm.substring_dedup import Packed, remove_repeats, shared_windows
from rolloom.llm.texts import Codes, byte_words, covered, window_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """{(id, text): (n_words, n_removed, kept)} by a table of all windows."""
    least = {}
    split = [(i, t, WORD.findall(t or "")) for i, t in rows]
    for i, _, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            value = float("inf") if i is None else i
            least[key] = min(least.get(key, value), value)
    out = []
    for i, _, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if least[tuple(words[at : at + window])] < (float("inf") if i is None else i):
                gone.update(range(at, at + window))
        kept = [w for at, w in enumerate(words) if at not in gone]
        out.append((i, len(words), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def test_whole_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = sorted(map(tuple, remove_repeats(docs, "doc_id", "text", 13).collect()), key=str)
    assert found == brute(rows, 13)
    assert sum(r[2] for r in found) > 1000


def test_edges(rows):
    long = " ".join(f"w{i}" for i in range(40))
    data = [
        (5, long, "a"), (5, long, "b"), (9, "x " + long, "c"), (None, long, "d"), (None, long, "e"),
        (7, None, "f"), (8, "", "g"), (10, " \t\n", "h"), (11, "one two", "i"), (2, " " + long, "j"),
        (12, "same " * 3000, "k"), (13, "same " * 40 + "other", "l"),
    ]
    df = rows("doc_id long, text string, bucket string", data)
    found = sorted(map(tuple, remove_repeats(df, "doc_id", "text", 5, groups=3, buckets=7).collect()), key=str)
    assert found == brute([(i, t) for i, t, _ in data], 5)


def test_empty_table(rows):
    assert remove_repeats(rows("doc_id long, text string", []), "doc_id", "text").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.integers(1, 6), st.integers(1, 5))
def test_pieces_hold_every_window(texts, window, buckets):
    packed = Packed(buckets, window)
    where = [packed.add([w.encode() for w in words], at) for at, words in enumerate(texts)]
    windows = defaultdict(set)
    for at, words in enumerate(texts):
        for begin in range(len(words) - window + 1):
            windows[tuple(words[begin : begin + window])].add(at)
    found = {b: shared_windows([packed.payload(b)], window)[0] for b in packed.entries}
    for at, words in enumerate(texts):
        seen = 0
        for bucket, entry, begin, n in where[at]:
            counts = np.array(packed.words[bucket]) - window + 1
            offset = int(counts[:entry].sum())
            told = dict(zip(found[bucket][0].tolist(), found[bucket][1].tolist()))
            for k in range(n):
                docs = windows[tuple(words[begin + k : begin + k + window])]
                assert told.get(offset + k) == (min(docs) if len(docs) > 1 else None)
            seen += n
        assert seen == max(0, len(words) - window + 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 13))
def test_window_codes(numbers, width):
    codes = window_codes(np.array(numbers, np.int64), width)
    windows = [tuple(numbers[i : i + width]) for i in range(len(numbers) - width + 1)]
    assert len(codes) == len(windows)
    assert all((codes[i] == codes[j]) == (windows[i] == windows[j]) for i in range(len(windows)) for j in range(i))


def test_words_and_cover():
    text = "a b c\x1fd\te\x0bf\x85g"
    assert [w.decode() for w in byte_words(text)] == WORD.findall(text)
    assert byte_words(None) == []
    assert Codes().numbers(["x", "y", "x"]).tolist() == [0, 1, 0]
    assert covered(np.array([True, False, False]), 2, 4).tolist() == [True, True, False, False]


@pytest.mark.parametrize("window", [1, 2, 13])
def test_short_texts(rows, window):
    df = rows("doc_id long, text string", [(1, "a"), (2, "a"), (3, "a b")])
    found = sorted(map(tuple, remove_repeats(df, "doc_id", "text", window).collect()))
    assert found == brute([(1, "a"), (2, "a"), (3, "a b")], window)

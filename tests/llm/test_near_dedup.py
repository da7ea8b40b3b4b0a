import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rolloom.llm import near_dedup as N
from rolloom.llm.texts import byte_words


def jaccard(a, b):
    a, b = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in (a, b))
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both) if a or b else 0.0


def classes_by_hand(rows, similar=0.8):
    """Class of each distinct (id, text): union over all pairs."""
    nodes = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=str)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = {n: byte_words(n[2]) for n in nodes}
    for a, b in combinations(nodes, 2):
        if a[2] == b[2] or N.similarity(words[a], words[b], similar) >= similar:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g, key=lambda m: (m[0], m[1] or 0))[1] for g in groups.values() for n in g}


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    by_hand = classes_by_hand(rows)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs, "doc_id", "text").collect()}
    assert got == {i: by_hand[(False, i, t)] for i, t in rows}
    assert len(set(got.values())) < len(got)


def test_many_near_copies_of_one_text(rows):
    """A hot group: copies of copies, each with a few words changed, and one text in between."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    data, made = [(0, " ".join(base))], [base]
    for i in range(1, 150):
        words = list(rng.choice(made))
        for _ in range(rng.choice([1, 1, 2, 4])):
            words[rng.randrange(120)] = f"x{rng.randrange(40)}"
        made.append(words)
        data.append((i, " ".join(words)))
    data += [(1000 + i, f"other text {i} of its own words {i * 7} {i * 11} {i * 13}") for i in range(50)]
    by_hand = classes_by_hand(data)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(rows("doc_id long, text string", data), "doc_id", "text").collect()}
    pairs = [(a, b) for a, b in combinations(got, 2) if by_hand[(False, a, data_text(data, a))] == by_hand[(False, b, data_text(data, b))]]
    found = sum(got[a] == got[b] for a, b in pairs)
    wrong = sum(got[a] == got[b] for a, b in combinations(got, 2)) - found
    assert wrong == 0 and found >= 0.99 * len(pairs)


def test_truncations_among_many_near_copies(rows):
    """Excerpts of a popular text have no shingle of their own, and every bucket they share is led by a copy."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    data = [(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(words)))
    cuts = [(0, 120), (0, 140), (130, 180), (132, 185), (0, 50), (0, 45), (20, 155), (10, 172), (60, 136), (61, 140)]
    data += [(1000 + i, " ".join(base[a:b])) for i, (a, b) in enumerate(cuts)]
    by_hand = classes_by_hand(data)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(rows("doc_id long, text string", data), "doc_id", "text").collect()}
    assert got == {i: by_hand[(False, i, t)] for i, t in data}
    assert got[1000] == got[1001] and got[1002] == got[1003]


def data_text(data, i):
    return next(t for j, t in data if j == i)


def test_edges(rows):
    long = " ".join(f"w{i}" for i in range(100))
    near = long.replace("w50", "other")
    far = " ".join(f"v{i}" for i in range(100))
    data = [
        (5, long), (3, near), (3, near), (9, long), (None, far), (None, far + " tail"), (7, None), (8, None), (10, ""), (11, ""),
        (12, " "), (13, "two words"), (14, "two  words"), (15, "two words more"), (16, "z " * 30_000), (17, "z " * 30_001), (18, long + "  "),
    ]
    df = rows("doc_id long, text string, keys int, node int", [(*d, 1, 2) for d in data])
    got = N.near_duplicates(df, "doc_id", "text").collect()
    classes = defaultdict(set)
    for r in got:
        classes[r.doc_id].add((r.class_id, r.class_size))
    assert len(got) == len(data)
    assert {k: v for k, v in classes.items() if k is not None} == {
        5: {(3, 5)}, 3: {(3, 5)}, 9: {(3, 5)}, 18: {(3, 5)}, 7: {(7, 1)}, 8: {(8, 1)}, 10: {(10, 2)}, 11: {(10, 2)},
        12: {(12, 1)}, 13: {(13, 2)}, 14: {(13, 2)}, 15: {(15, 1)}, 16: {(16, 2)}, 17: {(16, 2)},
    }
    assert classes[None] == {(None, 2)}
    kept = N.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([3, None, 7, 8, 10, 12, 13, 15, 16])
    assert N.near_duplicates(df.limit(0), "doc_id", "text").collect() == []
    assert N.keep_one(df.limit(0), "doc_id", "text").collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30), st.integers(0, 40))
def test_banded_alignment(left, right, band):
    a, b = (np.array([ord(c) for c in s], np.int64) for s in (left, right))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            hit = table[i, j] + 1 if a[i] == b[j] else 0
            table[i + 1, j + 1] = max(hit, table[i, j + 1], table[i + 1, j])
    if band >= 30:
        assert N.aligned(a, b, band) == table[-1, -1]
    else:
        assert N.aligned(a, b, band) <= table[-1, -1]


def test_similarity_is_that_of_shingles_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a = [b"%d" % rng.randrange(1000) for _ in range(rng.randrange(5, 120))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [b"new"] * rng.randrange(3)
        exact, found = jaccard(a, b), N.similarity(a, b)
        assert found <= exact + 1e-12
        assert (found >= 0.8) == (exact >= 0.8)


def test_sketches_see_order_and_occurrence():
    words = byte_words(" ".join(f"w{i}" for i in range(60)))
    keys = N.order_keys(N.labelled_shingles(words))
    assert keys == N.order_keys(N.labelled_shingles(list(words)))
    swapped = words[30:] + words[:30]
    assert len(set(keys) & set(N.order_keys(N.labelled_shingles(swapped)))) < len(keys)
    assert N.occurrence_labels(np.array([5, 7, 5, 5, 7], np.uint64)).tolist() == [0, 0, 1, 2, 1]
    assert N.order_keys(N.labelled_shingles([])) == []


def banded_by_hand(left, right, band):
    """Longest common subsequence whose matches lie in the band, cell by cell; cells outside it only pass values on."""
    row = [0] * (len(left) + 1)
    for j, code in enumerate(right):
        new = [0] * (len(left) + 1)
        for i, other in enumerate(left):
            match = row[i] + 1 if code == other and abs(i - j) <= band else 0
            new[i + 1] = max(match, row[i + 1], new[i])
        row = new
    return row[-1]


def test_alignment_slides_over_long_texts():
    rng = np.random.default_rng(4)
    for size, kinds, band in [(30, 5, 8), (400, 4, 20), (2600, 60, 40), (2600, 100_000, 25)]:
        left = rng.integers(0, kinds, size)
        right = np.insert(np.delete(left, rng.integers(1, size - 1, 5)), rng.integers(1, size - 6, 8), 7)
        left[[0, -1]], right[[0, -1]] = (-1, -2), (-3, -4)  # no common ends
        assert N.aligned(left, right, band) == banded_by_hand(left.tolist(), right.tolist(), band)


def test_comparisons_do_not_grow_with_the_square_of_a_group(rows, monkeypatch):
    """Texts that share most of their words with each other, but too few to be similar, are hardly compared."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    data = [(i, " ".join([*base[: rng.randrange(84, 90)], *(f"x{i}y{j}" for j in range(16))])) for i in range(120)]
    data += [(1000 + i, data[i][1].replace(f"x{i}y15", "end")) for i in range(0, 120, 7)]
    met = []
    compare = N._compare

    def counted(*args):
        out = compare(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(N, "_compare", counted)
    by_hand = classes_by_hand(data)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(rows("doc_id long, text string", data), "doc_id", "text").collect()}
    assert got == {i: by_hand[(False, i, t)] for i, t in data}
    assert len(set(got.values())) == 120
    assert sum(met) <= 20 * len(data)

"""Near duplicates by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.components import components
from rolloom.llm.texts import Codes, byte_words, window_codes
from rolloom.session import materialize

#: Words in a shingle, and least similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Least shingle hashes in a signature, and the share of them that two texts must have in common to be compared. Of two
#: texts at similarity 0.8 the signatures share 0.8 +- 0.05 of 64, so half is missed with probability below 1e-7. Two shorter
#: texts have all their hashes in it, which tells exactly how many they share.
SIGNATURE, COMMON = 64, 0.5
#: Bytes of texts that a task remembers while it compares.
REMEMBERED = 16_000_000
#: Sketches per text, and minima in a sketch. At similarity 0.8 a sketch agrees with probability
#: 0.8^3, so a pair is missed by all 16 with probability 1e-5.
SKETCHES, MINIMA = 16, 3

PAIRS = "lead long, node long, linked boolean"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_SEEDS = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x2545F4914F6CDD1D)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _B
    return values ^ (values >> np.uint64(29))


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in text order; a text of fewer words than ``width`` is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = _mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    width = min(width, len(words))
    out = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        out = out * _A + hashes[k : k + len(out)]
    return _mix(out)


def occurrence_labels(hashes: np.ndarray) -> np.ndarray:
    """For each hash how many equal ones stand before it."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
    at = np.arange(len(ranked))
    labels = np.empty(len(ranked), np.int64)
    labels[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return labels


def order_keys(labelled: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA) -> list[int]:
    """One 64-bit key per sketch of labelled shingles in text order.

    Each sketch orders them by a hash of its own, takes the ``minima`` least (all, if there are fewer)
    and hashes those in the order in which the text has them.
    """
    n = len(labelled)
    if not n:
        return []
    take = min(minima, n)
    chosen = np.empty((sketches, take), np.uint64)
    step = max(1, 1_000_000 // n)  # sketches at once
    for first in range(0, sketches, step):
        value = (labelled[None, :] ^ _SEEDS[first : min(first + step, sketches), None]) * _B
        value ^= value >> np.uint64(32)
        least = np.argpartition(value, take - 1, axis=1)[:, :take]
        chosen[first : first + step] = labelled[np.sort(least, axis=1)]
    keys = _SEEDS[:sketches].copy()
    for column in chosen.T:
        keys = (keys ^ column) * _A
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64).tolist()


def labelled_shingles(words: list[bytes]) -> np.ndarray:
    """Shingle hashes in text order, where the second, third ... of equal ones differ from the first."""
    hashes = shingle_hashes(words)
    return _mix(hashes + occurrence_labels(hashes).astype(np.uint64) * _A)


def aligned(left: np.ndarray, right: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two code arrays within ``band`` of the diagonal.

    Common ends are matched first. The rest is aligned row by row in bit vectors: a bit stands for a
    position of ``left``, and a row sees only the matches that lie in its band. The vector holds the positions
    that a step of rows can see and slides along, so the work is length times band.
    """
    short = min(len(left), len(right))
    differ = np.nonzero(left[:short] != right[:short])[0]
    head = int(differ[0]) if len(differ) else short
    left, right = left[head:], right[head:]
    short -= head
    if not short:
        return head
    differ = np.nonzero(left[::-1][:short] != right[::-1][:short])[0]
    tail = int(differ[0]) if len(differ) else short
    left, right = left[: len(left) - tail], right[: len(right) - tail]
    codes, others = left.tolist(), right.tolist()
    wide, step = (1 << (2 * band + 1)) - 1, max(1024, 2 * band + 1)
    row, low, high, matched = 0, 0, 0, 0
    for first in range(0, len(others), step):
        # positions before the band of all further rows are settled; those that the next rows may see come in
        start, end = min(len(codes), max(0, first - band)), min(len(codes), first + step + band)
        gone = start - low
        matched += gone - (row & ((1 << gone) - 1)).bit_count()
        row = (row >> gone) | (((1 << (end - high)) - 1) << (high - start))
        low, high = start, end
        full = (1 << (high - low)) - 1
        where: dict[int, int] = {}
        for at, code in enumerate(codes[low:high]):
            where[code] = where.get(code, 0) | (1 << at)
        for at, code in enumerate(others[first : first + step], first):
            match = where.get(code)
            if match:
                shift = at - band - low
                match &= (wide << shift) if shift >= 0 else (wide >> -shift)
                both = row & match
                row = ((row + both) | (row - both)) & full
    return head + tail + matched + high - low - row.bit_count()


def similarity(left: list[bytes], right: list[bytes], least: float = SIMILAR) -> float:
    """Jaccard similarity of the shingles that a banded alignment of two texts can match in order.

    With c matched of n and m shingles it is c / (n + m - c). Where that reaches ``least``, at most
    (n + m) (1 - least) / (1 + least) shingles are unmatched, and no matched pair is further off the
    diagonal, so a band that wide loses nothing. Shingles common to both in any order bound c from
    above; a pair whose bound is too low is given 0 without alignment.
    """
    width = SHINGLE
    if min(len(left), len(right)) < width:
        return 1.0 if left == right and left else 0.0
    codes = Codes()
    a, b = codes.numbers(left), codes.numbers(right)
    between = len(codes) + np.arange(width - 1)
    shingles = window_codes(np.concatenate((a, between, b)), width)
    a, b = shingles[: len(a) - width + 1], shingles[len(a) + width - 1 :]
    total = len(a) + len(b)
    common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    if common < least * (total - common):
        return 0.0
    matched = aligned(a, b, int(total * (1 - least) / (1 + least)) + 1)
    return matched / (total - matched)


def sketch_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id``, ``digest`` (MD5 of the text), ``keys`` and ``shingles`` (their number); a null text has but the id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(text).alias("digest"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else labelled_shingles(byte_words(t)) for t in batch.column(2).to_pylist()]
            keys = [None if f is None else order_keys(f) for f in found]
            sizes = [None if f is None else len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                names=["id", "digest", "keys", "shingles"],
            )

    return rows.mapInArrow(run, "id long, digest string, keys array<long>, shingles long")


def _signed(texts: DataFrame) -> DataFrame:
    """``node``, ``text``, ``shingles`` (their number) and ``signature``: 32 bits of each of the SIGNATURE least hashes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures, sizes = [], []
            for text in batch.column(1).to_pylist():
                found = labelled_shingles(byte_words(text))
                least = np.partition(found, SIGNATURE - 1)[:SIGNATURE] if len(found) > SIGNATURE else found
                signatures.append(least.astype(np.uint32).view(np.int32))
                sizes.append(len(found))
            made = [pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["node", "text", "shingles", "signature"])

    return texts.mapInArrow(run, "node long, text string, shingles long, signature array<int>")


def _overlap(left: Column, right: Column, similar: float) -> Column:
    """How many shingles two texts of so many shingles have in common at least if their similarity is ``similar``."""
    return F.ceil((left + right) * (similar / (1 + similar)) - 1e-6)


def _plausible(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs ``lead`` and ``node`` whose numbers of shingles and signatures allow that they are similar."""
    signs = texts.select("node", "shingles", "signature")
    pairs = pairs.join(signs.toDF("lead", "shingles_a", "one"), "lead").join(signs.toDF("node", "shingles_b", "two"), "node")
    near = F.least("shingles_a", "shingles_b") >= similar * F.greatest("shingles_a", "shingles_b") - 1e-6
    common = F.size(F.array_intersect("one", "two"))
    whole = F.greatest("shingles_a", "shingles_b") <= SIGNATURE
    enough = F.when(whole, _overlap(F.col("shingles_a"), F.col("shingles_b"), similar))
    enough = enough.otherwise(COMMON * F.least(F.size("one"), F.size("two")))
    return pairs.where(near & (common >= enough)).select("lead", "node")


def _compare(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """``lead``, ``node`` and whether they are ``linked``, for the plausible ones of pairs.

    The pairs are stored first: their size is then known, and few pairs go to the texts instead of all texts to them.
    """
    pairs = materialize(_plausible(materialize(pairs, "met"), texts, similar), "pairs")
    left = texts.select(F.col("node").alias("lead"), F.col("text").alias("left"))
    right = texts.select("node", F.col("text").alias("right"))
    joined = pairs.join(left, "lead").join(right, "node").select("lead", "node", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[bytes]] = {}
        held = 0
        for batch in batches:
            linked = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                for t in (one, two):
                    if t not in known:
                        known[t] = byte_words(t)
                        held += len(t)
                linked.append(similarity(known[one], known[two], similar) >= similar)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["lead", "node", "linked"])

    return joined.mapInArrow(run, PAIRS)


def _named(graph: DataFrame, column: str) -> DataFrame:
    return graph.select(F.col("node").alias(column), F.col("component").alias(f"{column}_comp"))


def _merge(graph: DataFrame | None, linked: DataFrame) -> DataFrame | None:
    """The graph with the components joined that ``linked`` pairs tie; None if it ties none.

    Only the pairs across components are looked at, as edges between components.
    """
    linked = linked.where("linked")
    if graph is None:
        new = linked.select("lead", "node", F.col("lead").alias("a"), F.col("node").alias("b"))
        graph = new.select("node", F.col("node").alias("component")).limit(0)
    else:
        named = linked.join(_named(graph, "lead"), "lead", "left").join(_named(graph, "node"), "node", "left")
        a, b = F.coalesce("lead_comp", "lead"), F.coalesce("node_comp", "node")
        new = named.select("lead", "node", a.alias("a"), b.alias("b")).where("a <> b")
    new = materialize(new, "bridges")
    if new.isEmpty():
        return None
    tied = components(new, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("into"))
    ends = new.select("lead", "a").union(new.select("node", "b")).toDF("node", "component").distinct()
    members = graph.union(ends).distinct()
    joined = members.join(tied, "component", "left")
    return materialize(joined.select("node", F.coalesce("into", "component").alias("component")), "graph")


def _componented(rows: DataFrame, graph: DataFrame | None) -> DataFrame:
    """``rows`` with the component ``comp`` of each ``node``; one without a link is its own."""
    if graph is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(_named(graph, "node"), "node", "left").withColumn("comp", F.coalesce("node_comp", "node")).drop("node_comp")


def _divided(rows: DataFrame) -> DataFrame:
    """``key`` of groups with nodes of several components, and ``major``, the component of most of them."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
    parts = parts.agg(F.count("*").alias("parts"), F.max(F.struct("n", "comp")).alias("most"))
    return parts.where("parts > 1").select("key", F.col("most")["comp"].alias("major"))


def _rare(texts: DataFrame, similar: float) -> DataFrame:
    """``key``, ``node``, ``shingles``, ``place`` and ``first``: the rarest shingles of each text, as keys under which similar ones meet.

    All shingles are ranked by the number of texts that have them, rarest first, ties by value; ``place`` is a shingle's rank in
    its text, from 1. Texts of n <= m shingles that are ``similar`` have o = (n + m) similar / (1 + similar) or more in common,
    so the first of these is at place n - o + 1 or before in the one, m - o + 1 or before in the other: in any text
    among the first 1 - similar of its places, and in the one with fewer shingles among even fewer (``first``). Shingles of
    one text alone take places but are no keys, and a text with too many of them has no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled_shingles(byte_words(t)) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64)
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            made = [batch.column(0).take(at), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))]
            yield pa.RecordBatch.from_arrays(made, names=["node", "shingles", "key"])

    every = materialize(texts.select("node", "text").mapInArrow(run, "node long, shingles long, key long"), "shingles")
    spread = every.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    ranked = every.join(spread, "key").groupBy("node", "shingles").agg(F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("shared"))
    reach = lambda share: F.col("shingles") - F.ceil(F.col("shingles") * share - 1e-6) + 1
    alone = F.col("shingles") - F.size("shared")
    ranked = ranked.withColumn("alone", alone).withColumn("first", reach(2 * similar / (1 + similar)))
    ranked = ranked.withColumn("shared", F.slice("shared", F.lit(1), F.greatest(F.lit(0), reach(similar) - F.col("alone")).cast("int")))
    keys = ranked.select("node", "shingles", "alone", "first", F.posexplode("shared").alias("at", "one"))
    return keys.select(F.col("one")["key"].alias("key"), "node", "shingles", (F.col("alone") + F.col("at") + 1).alias("place"), "first")


def _crossing(rows: DataFrame, similar: float) -> DataFrame:
    """``lead`` and ``node``: the pairs of different components that rows of ``_rare`` with their ``comp`` leave possible.

    In each group, the nodes outside its largest component meet all others. Left out are pairs whose numbers of shingles are further
    apart than ``similar``, and those that have too few shingles left after the places of the one they meet under.
    """
    rows = rows.join(_divided(rows), "key")
    columns = ["node", "shingles", "place", "first", "comp"]
    one = rows.where("comp <> major").select("key", *(F.col(c).alias(f"{c}_a") for c in columns))
    two = rows.select("key", *(F.col(c).alias(f"{c}_b") for c in columns))
    near = F.least("shingles_a", "shingles_b") >= similar * F.greatest("shingles_a", "shingles_b") - 1e-6
    fewer = F.struct("shingles_a", "node_a") < F.struct("shingles_b", "node_b")
    soon = F.when(fewer, F.col("place_a") <= F.col("first_a")).otherwise(F.col("place_b") <= F.col("first_b"))
    left = 1 + F.least(F.col("shingles_a") - F.col("place_a"), F.col("shingles_b") - F.col("place_b"))
    enough = left >= _overlap(F.col("shingles_a"), F.col("shingles_b"), similar)
    met = one.join(two, "key").where((F.col("comp_a") != F.col("comp_b")) & near & soon & enough)
    return met.select(F.greatest("node_a", "node_b").alias("lead"), F.least("node_a", "node_b").alias("node")).distinct()


def _links(groups: DataFrame, weights: DataFrame, texts: DataFrame, similar: float) -> DataFrame | None:
    """``component`` of each ``node`` that is linked to another, from rows (key, node) of groups."""
    heads = groups.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("head"))
    heads = heads.select("key", F.col("head")["node"].alias("lead"))
    led = groups.join(heads, "key").where("node <> lead").select("lead", "node").distinct()
    graph = _merge(None, materialize(_compare(led, texts, similar), "led"))

    named = materialize(_componented(groups, graph), "named")
    divided = materialize(named.join(_divided(named), "key", "left_semi").select("node").distinct(), "divided")
    if divided.isEmpty():
        return graph
    rare = materialize(_rare(texts.join(divided, "node", "left_semi"), similar), "rare")
    rows = materialize(_componented(rare, graph), "meeting")
    # the heaviest of each group first, so that most of a large class is one component before the rest meets
    heads = rows.join(_divided(rows), "key").join(weights.select("node", "weight"), "node")
    heads = heads.groupBy("key").agg(F.max(F.struct("weight", "node", "comp")).alias("head"))
    heads = heads.select("key", F.col("head")["node"].alias("lead"), F.col("head")["comp"].alias("led"))
    led = rows.join(heads, "key").where("comp <> led").select("lead", "node").distinct()
    merged = _merge(graph, materialize(_compare(led, texts, similar), "led"))
    graph = graph if merged is None else merged
    across = _crossing(materialize(_componented(rare, graph), "meeting"), similar).join(led, ["lead", "node"], "left_anti")
    merged = _merge(graph, materialize(_compare(across, texts, similar), "across"))
    return graph if merged is None else merged


def near_duplicates(docs: DataFrame, doc_id: str, text: str, similar: float = SIMILAR) -> DataFrame:
    """One row per document: ``doc_id``, ``digest``, ``class_id``, ``class_size`` and ``kept``.

    Classes are the connected components of exact copies and of pairs of texts whose similarity (see
    ``similarity``) is ``similar`` or more. ``class_id`` is the least id in the class and ``kept`` marks
    the row of that id (of several rows with one id and text, all; see ``keep_one``). A null text is a
    class of its own, and kept. Texts without words are copies only of equal texts. A null id counts
    as greater than any other. Empty table: empty result. Only the two named columns are read.

    Equal texts are reduced to one node inside tasks before the shuffle, so thousands of copies cost
    as much as one. Nodes that share a sketch key form a group. Each is compared, over the whole texts, with one lead
    of its group: the node whose keys are most common, which in a large group of
    copies is the text that the others were made from. In groups that then still have several classes, nodes meet under their
    rarest shingles (see ``_rare``), which loses no pair: texts that share but a passage, however many, have rarer
    shingles besides and do not meet. So what is compared follows the texts and not the pairs in a group.
    """
    rows = materialize(sketch_rows(docs, doc_id, text), "sketches")
    grouped = (
        rows.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("shingles").alias("shingles"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = materialize(grouped, "nodes")
    members = nodes.select("node", "shingles", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    joined = materialize(members.join(buckets, "key"), "members")
    weights = materialize(joined.groupBy("node").agg(F.sum("size").alias("weight"), F.first("shingles").alias("shingles")), "weights")

    candidates = nodes.join(weights, "node").select("node", F.col("digest").alias("_digest"), F.col("id").alias("_id"))
    candidates = materialize(candidates, "candidates")  # its size is then known before the texts are shuffled
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(text).alias("digest"), F.col(text).alias("text"))
    found = keyed.join(candidates, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")))
    texts = materialize(_signed(found.select("node", "text").dropDuplicates(["node"])), "texts")

    graph = _links(joined.select("key", "node"), weights, texts, similar)
    if graph is None:
        classes = nodes.withColumn("comp", F.col("node"))
    else:
        classes = nodes.join(graph, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    heads = classes.groupBy("comp").agg(F.min(best).alias("head"), F.sum("copies").alias("class_size"))
    named = classes.select("digest", "comp").join(heads, "comp")
    named = materialize(named.select(F.col("digest").alias("_digest"), "head", "class_size"), "classes")
    joined = rows.select("id", "digest").join(named, F.col("digest") == F.col("_digest"), "left")
    alone = F.col("digest").isNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("head")["id"]).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | ((F.col("digest") == F.col("head")["digest"]) & F.col("id").eqNullSafe(F.col("head")["id"]))).alias("kept"),
    )


def keep_one(docs: DataFrame, doc_id: str, text: str, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``; rows with a null text all stay.

    Of rows with one id and one text, which may differ in other columns, any one stays.
    """
    marked = near_duplicates(docs, doc_id, text, similar).where("kept AND digest IS NOT NULL")
    kept = materialize(marked.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), "kept")
    keyed = docs.withColumn("_nd_key", F.md5(text))

    def rows_of(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select(F.col("doc_id").alias("_nd_id"), F.col("digest").alias("_nd_digest"))
        same = (F.col("_nd_key") == F.col("_nd_digest")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_nd_id"))
        return keyed.join(chosen, same, "left_semi")

    one = rows_of(kept.where("rows = 1"))
    repeated = kept.where("rows > 1")
    if not repeated.isEmpty():
        one = one.union(rows_of(repeated).dropDuplicates(["_nd_key"]))
    return one.drop("_nd_key").union(docs.where(F.col(text).isNull()))

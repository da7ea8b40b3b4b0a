"""Collocations per language: prefix-free parsing, and counts of word n-grams in the distinct chunks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.texts import Codes
from rolloom.plans.ordered import top_rows
from rolloom.session import materialize

#: A window of words starts a chunk with probability 1 / TRIGGER.
TRIGGER = 32
#: A chunk without a trigger is cut after so many words; where a cut falls changes no count.
LONGEST = 4096
#: Bytes of text behind one block of the dictionary, and behind one bucket of n-gram hashes.
BLOCK_BYTES = 8 << 20
#: Chunks whose words are numbered at once.
SLICE = 2000
#: Bytes of chunks that a task gathers before it sends their counts.
FLUSH_BYTES = 4 << 20
#: The token between two pieces of a text, which no n-gram crosses.
BREAK = b"\n"

# A-Z in lower case; the characters that end a piece; a tab parts words as a space does.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

_A, _B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def tokens(text: bytes, tail: int) -> list[bytes]:
    """The words of a text with a BREAK after each piece, closed by at least ``tail`` BREAKs; empty without words."""
    out: list[bytes] = []
    for piece in text.translate(_FOLD).split(b"\n"):
        words = piece.split()
        if words:
            out += words
            out.append(BREAK)
    if out:
        out += [BREAK] * (tail - 1)
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def parse(text: bytes, tail: int, trigger: int = TRIGGER, longest: int = LONGEST) -> list[bytes]:
    """Chunks of a text. Each ends with the ``tail`` tokens that the next one begins with.

    Those tokens are a window whose hash triggers a cut, so equal passages are cut at equal places.
    An n-gram of up to ``tail`` + 1 words belongs to the chunk where it starts before the last
    ``tail`` tokens: each occurrence belongs to exactly one chunk and lies wholly in it.
    """
    words = tokens(text, tail)
    if not words:
        return []
    n = len(words) - tail  # starts that some chunk owns
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    windows = hashes[:n].copy()
    for k in range(1, tail):
        windows = windows * _A + hashes[k : k + n] * _B
    cuts = np.nonzero(_mixed(windows) % np.uint64(trigger) == 0)[0]
    edges = np.concatenate(([0], cuts[cuts > 0], [n]))
    if (np.diff(edges) > longest).any():
        edges = np.unique(np.concatenate([np.append(np.arange(a, b, longest), b) for a, b in zip(edges[:-1], edges[1:])]))
    joined = b" ".join(words)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    return [joined[a:b] for a, b in zip(offsets[edges[:-1]].tolist(), (offsets[edges[1:] + tail] - 1).tolist())]


class Block:
    """The distinct chunks of a block with their parse frequencies, as numbered words."""

    def __init__(self, langs: list[str], chunks: list[bytes], times: list[int], tail: int):
        merged: dict[tuple[str, bytes], int] = {}
        for lang, chunk, n in zip(langs, chunks, times):
            merged[lang, chunk] = merged.get((lang, chunk), 0) + n
        self.tail = tail
        lang_codes, codes = Codes(), Codes()
        self.lang = lang_codes.numbers([lang for lang, _ in merged])
        self.weight = np.fromiter(merged.values(), np.int64, len(merged))
        distinct = [chunk for _, chunk in merged]
        sizes = np.fromiter((chunk.count(b" ") + 1 for chunk in distinct), np.int64, len(distinct))
        parts = [b" ".join(distinct[at : at + SLICE]).split(b" ") for at in range(0, len(distinct), SLICE)]
        self.words = np.concatenate([codes.numbers(part).astype(np.int32) for part in parts])
        self.chunk = np.repeat(np.arange(len(distinct), dtype=np.int32), sizes)
        left = np.cumsum(sizes)[self.chunk] - np.arange(len(self.words))  # tokens from here to the chunk's end
        self.word = self.words != codes.get(BREAK, -1)
        self.first = (left > tail) & self.word
        self.names, self.spelled = list(lang_codes), list(codes)
        spread = lambda names: np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))
        self.word_hash, self.lang_hash = spread(self.spelled), spread(self.names)[self.lang]

    def ngrams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size the positions where an n-gram starts that belongs to its chunk, and its hashes."""
        fits = self.first.copy()
        for size in range(1, self.tail + 2):
            if size > 1:
                fits[: 1 - size] &= self.word[size - 1 :]
            starts = np.nonzero(fits)[0]
            hashes = self.lang_hash[self.chunk[starts]] + np.uint64(size)
            for k in range(size):
                hashes = _mixed((hashes ^ self.word_hash[self.words[starts + k]]) * _A)
            yield size, starts, hashes

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of all n-grams in ascending order, and how often each occurs."""
        parts = []
        for _, starts, hashes in self.ngrams():
            order = np.argsort(hashes)
            parts.append(summed(hashes[order], self.weight[self.chunk[starts[order]]]))
        hashes, counts = (np.concatenate(part) for part in zip(*parts))
        order = np.argsort(hashes)
        return summed(hashes[order], counts[order])

    def totals(self) -> list[tuple[str, int]]:
        """Occurrences of words per language."""
        at = self.chunk[self.first]
        counts = np.zeros(len(self.names), np.int64)
        np.add.at(counts, self.lang[at], self.weight[at])
        return list(zip(self.names, counts.tolist()))

    def counted(self, hashes: np.ndarray) -> Iterator[tuple[list[str], list[bytes], np.ndarray]]:
        """Language, words and count of each distinct n-gram whose hash is one of ``hashes`` (ascending)."""
        if not len(hashes):
            return
        low = np.uint64((1 << 22) - 1)
        likely = np.zeros(1 << 22, bool)  # spares most others the search
        likely[hashes & low] = True
        for size, starts, own in self.ngrams():
            some = likely[own & low]
            starts, own = starts[some], own[some]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            starts = starts[hashes[at] == own]
            if not len(starts):
                continue
            group = self.lang[self.chunk[starts]]
            for k in range(size):
                group = np.unique(group * len(self.spelled) + self.words[starts + k], return_inverse=True)[1]
            _, first = np.unique(group, return_index=True)
            counts = np.zeros(len(first), np.int64)
            np.add.at(counts, group, self.weight[self.chunk[starts]])
            shown = starts[first]
            spelled = [self.spelled[c] for c in self.words[shown].tolist()]
            for k in range(1, size):
                spelled = [a + b" " + self.spelled[c] for a, c in zip(spelled, self.words[shown + k].tolist())]
            yield [self.names[c] for c in self.lang[self.chunk[shown]].tolist()], spelled, counts


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted ``hashes`` and the sums of their ``counts``."""
    if not len(hashes):
        return hashes, counts
    first = np.concatenate(([0], np.nonzero(hashes[1:] != hashes[:-1])[0] + 1))
    return hashes[first], np.add.reduceat(counts, first)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint64)
    half = len(data) // 2
    return np.cumsum(data[:half]), data[half:].astype(np.int64)


def _bounds(buckets: int) -> np.ndarray:
    """Where the ranges of hashes of each bucket begin, the first left out."""
    return np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)


def _parts(docs: DataFrame, text: str, least: int) -> int:
    size = docs.select(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    return max(least, -(-size // BLOCK_BYTES))


def phrase_counts(
    docs: DataFrame, text: str, lang: str, min_count: int = 10, max_words: int = 3, parts: int | None = None
) -> DataFrame:
    """``lang``, ``phrase``, ``n``: all n-grams of 1 to ``max_words`` words found ``min_count`` times or more in a language.

    The row with an empty phrase counts all words of the language. Phrases are space-joined; counts are exact.

    1. Tasks parse their texts into chunks and send each distinct one once, with its frequency, to the
       block that its hash names: a text that a third of all documents repeat arrives once per task.
    2. A block has the dictionary of its chunks with parse frequencies. It sums its n-grams' frequencies by a 64-bit hash and
       sends one packed string to every range of hashes.
    3. Each range adds these up and tells each block which of its hashes reach ``min_count``. Equal n-grams
       have equal hashes, so none is missed; phrases that share a hash only make a few more pass.
    4. Blocks spell out those n-grams, and a grouping by the words themselves adds up the exact counts.

    Blocks and ranges are cut from the summed size of the texts (BLOCK_BYTES each), so no task grows with the input.
    """
    tail = max(max_words - 1, 1)
    parts = parts or _parts(docs, text, 1)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    kinds = "block int, lang string, chunk binary, n long"

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes], int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            chunks = [c for _, c in found]
            blocks = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in chunks), np.uint64, len(chunks)) % np.uint64(parts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks.astype(np.int32)),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array(chunks, pa.binary()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["block", "lang", "chunk", "n"],
            )

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in parse(value, tail) if value else ():
                    key = name, piece
                    times = found.get(key)
                    if times is None:
                        size += len(piece) + 150
                        found[key] = 1
                    else:
                        found[key] = times + 1
                if size > FLUSH_BYTES:
                    yield flush()
                    found.clear()
                    size = 0
        if found:
            yield flush()

    def block_of(table: pa.Table) -> Block:
        return Block(*(table.column(c).to_pylist() for c in ("lang", "chunk", "n")), tail)

    def send(table: pa.Table) -> pa.Table:
        hashes, counts = block_of(table).hashed()
        edges = [0, *np.searchsorted(hashes, _bounds(parts)).tolist(), len(hashes)]
        cuts = [(b, i, j) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
        zero = np.uint64(0)
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()] * len(cuts), pa.int32()),
                "payload": pa.array(
                    [_pack(np.diff(hashes[i:j], prepend=zero), counts[i:j].astype(np.uint64)) for _, i, j in cuts], pa.binary()
                ),
            }
        )

    def add(table: pa.Table) -> pa.Table:
        hashes, counts, blocks = [], [], table.column("block").to_pylist()
        for payload in table.column("payload"):
            some, times = _unpack(payload.as_py())
            hashes.append(some)
            counts.append(times)
        every = np.concatenate(hashes)
        order = np.argsort(every)
        distinct, sums = summed(every[order], np.concatenate(counts)[order])
        frequent = distinct[sums >= min_count]
        told = [np.intersect1d(h, frequent, assume_unique=True) for h in hashes]
        return pa.table(
            {
                "block": pa.array([b for b, t in zip(blocks, told) if len(t)], pa.int32()),
                "hashes": pa.array([_pack(np.diff(t, prepend=np.uint64(0))) for t in told if len(t)], pa.binary()),
            }
        )

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        block = block_of(left)
        unpack = zstandard.ZstdDecompressor().decompress
        hashes = [np.cumsum(np.frombuffer(unpack(h.as_py()), np.uint64)) for h in right.column("hashes")]
        totals = block.totals()
        langs, phrases, counts = [name for name, _ in totals], [b""] * len(totals), [np.array([n for _, n in totals], np.int64)]
        for names, spelled, some in block.counted(np.sort(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)):
            langs += names
            phrases += spelled
            counts.append(some)
        return pa.table(
            {
                "lang": pa.array(langs, pa.string()),
                "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                "n": pa.array(np.concatenate(counts), pa.int64()),
            }
        )

    by_block = rows.mapInArrow(chunk, kinds).groupBy("block")
    sent = by_block.applyInArrow(send, "bucket int, block int, payload binary")
    told = sent.groupBy("bucket").applyInArrow(add, "block int, hashes binary")
    spelled = by_block.cogroup(told.groupBy("block")).applyInArrow(spell, "lang string, phrase string, n long")
    frequent = (F.col("phrase") == "") | (F.col("n") >= min_count)
    return spelled.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(frequent)


def _exact(column: str):
    return F.col(column).cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    text: str,
    lang: str,
    min_count: int = 10,
    max_words: int = 3,
    inside_percent: int = 50,
    top: int = 2000,
    parts: int | None = None,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z count as a-z; pieces end at ``.,;:!?`` and line ends; words are parted by spaces and tabs. A candidate
    is a phrase of 2 to ``max_words`` words found a >= ``min_count`` times within pieces. A cut after its first k words scores
    floor(1000000 * a * a / (l * r)) from the frequencies of both parts, in decimals of 38 digits; the lowest cut
    counts, ties to the smallest k. A candidate goes if a longer candidate holds its words in a row and is found at least
    ``inside_percent`` % as often. Order: score and a descending, then the phrase by its UTF-8 bytes.

    A null language is ``und``. Null and empty texts and texts without words add nothing. Repeated rows count each time. A
    very long text is cut into chunks like any other. Empty table, or no candidate: empty result. Only the two named columns are read.

    Candidates and their parts meet in joins by (language, phrase), one row per phrase on one side; the final ranking
    first ranks within 64 parts of a language.
    """
    counts = materialize(phrase_counts(docs, text, lang, min_count, max_words, parts), "phrases")
    words = F.split("phrase", " ")
    phrases = counts.where(F.col("phrase") != "")
    candidates = phrases.where(F.size(words) >= 2).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    size = F.size("words")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", joined(1, F.col("k")).alias("left"), joined(F.col("k") + 1, size - F.col("k")).alias("right")
    )
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    rated = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    rated = rated.withColumn("a19", _exact("a")).withColumn("l19", _exact("l")).withColumn("r19", _exact("r"))
    rated = rated.withColumn("score", F.expr("(a19 * a19 * 1000000) div (l19 * r19)"))
    lowest = rated.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.expr(
        "flatten(transform(sequence(2, greatest(size(words) - 1, 2)), m ->"
        " transform(sequence(1, greatest(size(words) - m + 1, 1)), s -> array_join(slice(words, s, m), ' '))))"
    )
    longer = (
        candidates.where(size > 2)
        .select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("around"))
        .groupBy("lang", "phrase")
        .agg(F.max("around").alias("around"))
    )
    inside = 100 * F.coalesce("around", F.lit(0)) >= inside_percent * F.col("a")
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(~inside)
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    ranked = top_rows(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    totals = counts.where(F.col("phrase") == "").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

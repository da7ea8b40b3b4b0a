"""Removal of repeated passages: super-k-mers carry windows of words to the bucket of their minimiser."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.texts import byte_words, covered

#: Words in the pieces whose least hash is a window's minimiser.
PIECE = 3
_NEVER = np.iinfo(np.int64).max
_A, _B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def minimisers(words: list[bytes], window: int) -> np.ndarray:
    """For each window of words the least hash of its pieces of PIECE words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    piece = min(PIECE, window)
    mixed = hashes[: len(hashes) - piece + 1].copy()
    for k in range(1, piece):
        mixed = mixed * _A + hashes[k : k + len(mixed)] * _B
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    mixed ^= mixed >> np.uint64(32)
    span, size = window - piece + 1, 1
    while size * 2 <= span:
        mixed = np.minimum(mixed[: len(mixed) - size], mixed[size:])
        size *= 2
    return np.minimum(mixed[:n], mixed[span - size : span - size + n])


class Packed:
    """The distinct super-k-mers of a group of documents, by bucket, in the order they appear."""

    def __init__(self, buckets: int, window: int):
        self.buckets, self.window = buckets, window
        self.entries: dict[int, dict[bytes, int]] = {}
        self.words: dict[int, list[int]] = {}
        self.first: dict[int, list[int]] = {}
        self.last: dict[int, list[int]] = {}

    def add(self, words: list[bytes], doc: int) -> list[tuple[int, int, int, int]]:
        """Cut one document; returns bucket, entry, first window and number of windows of each piece."""
        least = minimisers(words, self.window)
        if not len(least):
            return []
        ends = np.append(np.nonzero(least[1:] != least[:-1])[0] + 1, len(least))
        begins = np.concatenate(([0], ends[:-1]))
        where = (least[begins] % np.uint64(self.buckets)).astype(np.int64).tolist()
        joined = b" ".join(words)
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
        tail = self.window - 1
        cuts = zip(where, begins.tolist(), ends.tolist(), offsets[begins].tolist(), (offsets[ends + tail] - 1).tolist())
        out = []
        for bucket, begin, end, left, right in cuts:
            entries = self.entries.get(bucket)
            if entries is None:
                entries = self.entries[bucket] = {}
                self.words[bucket], self.first[bucket], self.last[bucket] = [], [], []
            piece = joined[left:right]
            at = entries.get(piece)
            if at is None:
                at = entries[piece] = len(entries)
                self.words[bucket].append(end - begin + tail)
                self.first[bucket].append(doc)
                self.last[bucket].append(doc)
            else:
                self.last[bucket][at] = doc
            out.append((bucket, at, begin, end - begin))
        return out

    def payload(self, bucket: int) -> bytes:
        """One packed string: counts of words, least and greatest document of each entry, and the words."""
        counts = np.array(self.words[bucket], np.int32)
        first, last = np.array(self.first[bucket], np.int64), np.array(self.last[bucket], np.int64)
        parts = [
            np.array([len(counts)], np.int64).tobytes(),
            counts.tobytes(),
            np.diff(first, prepend=0).tobytes(),
            (last - first).tobytes(),
            b" ".join(self.entries[bucket]),
        ]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    counts = np.frombuffer(data, np.int32, n, 8).astype(np.int64)
    first = np.cumsum(np.frombuffer(data, np.int64, n, 8 + 4 * n))
    last = first + np.frombuffer(data, np.int64, n, 8 + 12 * n)
    words = pc.split_pattern(pa.array([data[8 + 20 * n :]], pa.large_binary()), b" ").flatten()
    return counts, first, last, words


def _documents(table: pa.Table) -> list[tuple[int, str | None, int]]:
    """(id, text, row) of a group, in an order that every pass repeats; a null id comes last."""
    ids = table.column("id").to_pylist()
    texts = table.column("text").to_pylist()
    rows = [(_NEVER if i is None else i, t or "", at) for at, (i, t) in enumerate(zip(ids, texts))]
    return sorted(rows, key=lambda r: (r[0], r[1]))


def shared_windows(payloads: list[bytes], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each payload of a bucket the windows that stand in documents of different ids, as their
    numbers in the payload, with the least id of any document that has the same words there.

    Windows are sorted by a 64-bit hash of their words' numbers; those that meet are then told
    apart by the numbers themselves, so that only equal words count as equal.
    """
    flat, starts, first, last, sizes = [], [], [], [], []
    base = 0
    for payload in payloads:
        counts, low, high, words = unpack(payload)
        flat.append(words)
        windows = counts - window + 1
        begin = base + np.cumsum(counts) - counts
        inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        starts.append(np.repeat(begin, windows) + inner)
        first.append(np.repeat(low, windows))
        last.append(np.repeat(high, windows))
        sizes.append(int(windows.sum()))
        base += len(words)
    coded = pa.concat_arrays(flat).dictionary_encode()
    numbers, at = coded.indices.to_numpy().astype(np.int64), np.concatenate(starts)
    distinct = len(coded.dictionary)
    low, high = np.concatenate(first), np.concatenate(last)
    hashed = np.zeros(len(at), np.uint64)
    spread = numbers.astype(np.uint64) * _MIX
    spread ^= spread >> np.uint64(31)
    for k in range(window):
        hashed = hashed * _A + spread[at + k]
    _, group, count = np.unique(hashed, return_inverse=True, return_counts=True)
    some = np.nonzero((count[group] > 1) | (high > low))[0]
    answers = np.full(len(at), -1, np.int64)
    if len(some):
        exact = group[some].astype(np.int64)
        for k in range(window):
            exact = np.unique(exact * (distinct + 1) + numbers[at[some] + k], return_inverse=True)[1]
        least = np.full(exact.max() + 1, _NEVER, np.int64)
        most = np.full(exact.max() + 1, np.iinfo(np.int64).min, np.int64)
        np.minimum.at(least, exact, low[some])
        np.maximum.at(most, exact, high[some])
        shared = least[exact] < most[exact]
        answers[some[shared]] = least[exact][shared]
        told = np.zeros(len(at), bool)
        told[some[shared]] = True
    else:
        told = np.zeros(len(at), bool)
    out, base = [], 0
    for size in sizes:
        here = np.nonzero(told[base : base + size])[0]
        out.append((here, answers[base + here]))
        base += size
    return out


def remove_repeats(
    docs: DataFrame, doc_id: str, text: str, window: int = 13, groups: int | None = None, buckets: int | None = None
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` for every row.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id;
    windows are judged on the input. Kept words are joined by one space. A null or empty text has no
    words; texts shorter than a window lose none. Rows of equal id don't count against each other,
    so repeated rows stay alike. A null id counts as greater than any other. Empty table: empty
    result. Only the two named columns are read; the id must be an integer.

    Three steps in one plan, where the texts are shuffled once and read twice:
    1. documents meet in ``groups`` by a hash of id and text, and each group cuts its texts into
       super-k-mers, keeps the distinct ones with their least and greatest id, and sends one packed
       string per bucket. A passage in a third of all documents is one entry for each group.
    2. each bucket sorts its windows and sends back, per group, the numbers of those that other
       documents share, with the least id.
    3. groups and answers meet, and each document drops the covered words.
    Group and bucket sizes follow spark.sql.shuffle.partitions, which should grow with the data so
    that a group holds some 10 MB of text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = groups or parts, buckets or 2 * parts
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).withColumn(
        "grp", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int")
    )

    def pack(table: pa.Table) -> pa.Table:
        packed = Packed(buckets, window)
        for doc, value, _ in _documents(table):
            packed.add(byte_words(value), doc)
        names = sorted(packed.entries)
        return pa.table(
            {
                "bucket": pa.array(names, pa.int32()),
                "grp": pa.array([table.column("grp")[0].as_py()] * len(names), pa.int32()),
                "payload": pa.array([packed.payload(b) for b in names], pa.binary()),
            }
        )

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = shared_windows(table.column("payload").to_pylist(), window)
        told = [at for at, (windows, _) in enumerate(found) if len(windows)]
        compress = zstandard.ZstdCompressor(level=1).compress
        return pa.table(
            {
                "grp": table.column("grp").take(told) if told else pa.array([], pa.int32()),
                "bucket": table.column("bucket").take(told) if told else pa.array([], pa.int32()),
                "windows": pa.array([compress(found[i][0].astype(np.int64).tobytes()) for i in told], pa.binary()),
                "least": pa.array([compress(found[i][1].tobytes()) for i in told], pa.binary()),
            }
        )

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = Packed(buckets, window)
        pieces = []
        order = _documents(left)
        for doc, value, _ in order:
            pieces.append(packed.add(byte_words(value), doc))
        decompress = zstandard.ZstdDecompressor().decompress
        least, begins = {}, {}
        for bucket, windows, low in zip(*(right.column(c).to_pylist() for c in ("bucket", "windows", "least"))):
            counts = np.array(packed.words[bucket], np.int64) - window + 1
            begins[bucket] = np.cumsum(counts) - counts
            least[bucket] = np.full(int(counts.sum()), _NEVER, np.int64)
            least[bucket][np.frombuffer(decompress(windows), np.int64)] = np.frombuffer(decompress(low), np.int64)
        ids, sizes, removed, kept = [], [], [], []
        for (doc, value, _), cut in zip(order, pieces):
            words = byte_words(value)
            hit = None
            for bucket, at, begin, n in cut:
                known = least.get(bucket)
                if known is not None:
                    offset = begins[bucket][at]
                    smaller = known[offset : offset + n] < doc
                    if smaller.any():
                        if hit is None:
                            hit = np.zeros(len(words) - window + 1, bool)
                        hit[begin : begin + n] |= smaller
            gone = 0
            if hit is not None:
                drop = covered(hit, window, len(words)).tolist()
                gone = sum(drop)
                words = [w for w, d in zip(words, drop) if not d]
            ids.append(None if doc == _NEVER else doc)
            sizes.append(len(words) + gone)
            removed.append(gone)
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    by_group = rows.groupBy("grp")
    sent = by_group.applyInArrow(pack, "bucket int, grp int, payload binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "grp int, bucket int, windows binary, least binary")
    return by_group.cogroup(answers.groupBy("grp")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_text string"
    )

"""Token sequences in a keyed random order, as binary shards of fixed stride."""

from __future__ import annotations

import base64
import functools
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.session import scratch_path

# Fixed value: the pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers.
CACHE = 200_000
#: Rounds of the permutation.
ROUNDS = 6


class Tokenizer(NamedTuple):
    """A rank file that every executor can read, and the id that ends a document."""

    path: str
    end: int


@functools.lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SPLIT_SPACE = re.compile(r"\s ")


class Encoder:
    """Encodes texts; ids of words are remembered.

    The pattern never joins a space to what stands before it unless that is white space too. So
    where no space follows white space, a text may be cut before every space, and the pieces have
    the ids that they have in the text.
    """

    def __init__(self, path: str):
        self.encode = _encoding(path).encode_ordinary
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str) -> list[int]:
        if _SPLIT_SPACE.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        ids = list(self.encode(first))
        known = self.known
        for word in rest:
            found = known.get(word)
            if found is None:
                found = self.encode(" " + word)
                if len(known) < CACHE:
                    known[word] = found
            ids += found
        return ids


def permute(numbers: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 .. size - 1: a balanced Feistel network over the next power of four.

    Results that fall outside are permuted again until they are inside (cycle-walking), fewer than
    four times on average. ``inverse`` undoes it.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(zlib.crc32(f"{key}:{r}".encode()) << 31) for r in range(ROUNDS)]

    def scramble(value: np.ndarray, round_key: np.uint64) -> np.ndarray:
        mixed = (value + round_key) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed ^ (mixed >> np.uint64(32))) & low

    def once(value: np.ndarray) -> np.ndarray:
        left, right = value >> shift, value & low
        if inverse:
            for round_key in reversed(keys):
                left, right = right ^ scramble(left, round_key), left
        else:
            for round_key in keys:
                left, right = right, left ^ scramble(right, round_key)
        return (left << shift) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    outside = np.nonzero(out >= size)[0]
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= size]
    return out.astype(np.int64)


class Layout(NamedTuple):
    """Where a sequence stands: shard = slot // per_shard, at (slot % per_shard) x stride bytes."""

    path: str
    sequences: int
    length: int
    per_shard: int
    dtype: str
    key: int

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize

    def file(self, shard: int) -> str:
        return f"{self.path}/shard-{shard:08d}.bin"


def _store(uri: str, data: bytes) -> None:
    """Write under a name of its own, then move: a lost or repeated task leaves whole files only."""
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, path)


def read_slots(layout: Layout, first: int, count: int) -> np.ndarray:
    """Sequences of ``count`` slots from ``first`` on: the read that starts or resumes a training run."""
    last = min(first + count, layout.sequences)
    rows = []
    while first < last:
        shard, row = divmod(first, layout.per_shard)
        n = min(last - first, layout.per_shard - row)
        system, path = pyarrow.fs.FileSystem.from_uri(layout.file(shard))
        with system.open_input_file(path) as file:
            file.seek(row * layout.stride)
            rows.append(np.frombuffer(file.read(n * layout.stride), layout.dtype).reshape(n, layout.length))
        first += n
    return np.concatenate(rows) if rows else np.empty((0, layout.length), layout.dtype)


def _tokens(docs: DataFrame, doc_id: str, text: str, tokenizer: Tokenizer, dtype: str) -> DataFrame:
    """Ids of each document, with its partition and the tokens before it there, in storage order."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder(tokenizer.path), TaskContext.get().partitionId(), 0
        limit = np.iinfo(dtype).max
        for batch in batches:
            sizes, payloads = [], []
            for t in batch.column(1).to_pylist():
                ids = [*encoder(t), tokenizer.end] if t else []
                if ids and max(ids) > limit:
                    raise ValueError(f"ids do not fit {dtype}")
                sizes.append(len(ids))
                payloads.append(np.array(ids, dtype).tobytes())
            ends = before + np.cumsum(np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(sizes), pa.int32()),
                    pa.array(ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(payloads, pa.binary()),
                ],
                names=["doc_id", "part", "before", "n", "tokens"],
            )
            before = int(ends[-1]) if len(ends) else before

    return rows.mapInArrow(run, "doc_id long, part int, before long, n long, tokens binary")


def _pack(numbers: np.ndarray, begin: np.ndarray, sizes: np.ndarray, tokens: bytes) -> bytes:
    head = np.array([len(numbers)], np.int64)
    parts = (head, numbers.astype(np.int64), begin.astype(np.int32), sizes.astype(np.int32))
    return zstandard.ZstdCompressor(level=6).compress(b"".join(p.tobytes() for p in parts) + tokens)


def write_training_order(
    docs: DataFrame,
    doc_id: str,
    text: str,
    tokenizer: Tokenizer,
    path: str | None = None,
    length: int = 1024,
    per_shard: int = 4096,
    key: int = 1,
    dtype: str = "uint16",
) -> tuple[DataFrame, Layout]:
    """Write all texts as token sequences in a random order; one row per sequence, and the layout.

    Texts are tokenized, each ends with the tokenizer's end id, and the stream in storage order is
    cut into sequences of ``length`` ids, the last filled up with the end id. Sequence s goes to slot
    ``permute(s, sequences, key)``; files hold ``per_shard`` slots each in order, so a reader finds any
    slot by arithmetic and reads on from there. Rows: ``sequence``, ``slot``, ``shard``, ``byte_offset`` and
    ``crc32`` of the stored bytes. The files are written when the rows are computed.

    A null or empty text gives no ids. Repeated rows and ids are all written. Very long texts span
    sequences. An empty table gives no sequences and no files. Only the two named columns are read.

    Ids are stored once, compressed; counts per partition give every document its place in the
    stream. Runs of the stream are then cut, packed per shard and shuffled once. A task holds one
    shard (per_shard x length ids) whatever the size of the data; documents of any share of the rows
    make no key hot.
    """
    spark = docs.sparkSession
    store = scratch_path(spark, "tokens")
    _tokens(docs, doc_id, text, tokenizer, dtype).write.option("compression", "zstd").parquet(store)
    stored = spark.read.parquet(store)
    totals = stored.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").toArrow()  # a row per partition
    ends = np.cumsum(totals.column("total").to_numpy()) if totals.num_rows else np.zeros(1, np.int64)
    starts = dict(zip(totals.column("part").to_pylist(), (ends - totals.column("total").to_numpy()).tolist())) if totals.num_rows else {}
    everything = int(ends[-1])
    sequences = -(-everything // length)
    layout = Layout(path or scratch_path(spark, "order"), sequences, length, per_shard, dtype, key)
    begins = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            parts = batch.column("part").to_numpy()
            first = batch.column("before").to_numpy() + np.array([begins.value[p] for p in parts.tolist()], np.int64)
            payloads = batch.column("tokens").to_pylist()
            # documents that follow each other in the stream are one run
            breaks = np.nonzero(first[1:] != first[:-1] + sizes[:-1])[0] + 1
            made: dict[int, list] = {}
            for left, right in zip([0, *breaks.tolist()], [*breaks.tolist(), len(sizes)]):
                run = np.frombuffer(b"".join(payloads[left:right]), dtype)
                if not len(run):
                    continue
                at = int(first[left])
                numbers = np.arange(at // length, (at + len(run) - 1) // length + 1)
                low = np.maximum(numbers * length, at)
                high = np.minimum((numbers + 1) * length, at + len(run))
                slots = permute(numbers, sequences, key)
                shards = slots // per_shard
                order = np.argsort(shards, kind="stable")
                edges = np.nonzero(np.diff(shards[order]))[0] + 1
                for chosen in np.split(order, edges):
                    pieces = [run[low[i] - at : high[i] - at] for i in chosen.tolist()]
                    made.setdefault(int(shards[chosen[0]]), []).append(
                        (slots[chosen], low[chosen] - numbers[chosen] * length, (high - low)[chosen], pieces)
                    )
            names = sorted(made)
            packed = []
            for name in names:
                slots, begin, sizes_, pieces = zip(*made[name])
                tokens = b"".join(p.tobytes() for group in pieces for p in group)
                packed.append(_pack(np.concatenate(slots), np.concatenate(begin), np.concatenate(sizes_), tokens))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["shard", "payload"]
            )

    end = tokenizer.end

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = min(per_shard, sequences - shard * per_shard)
        out = np.full((rows, length), end, dtype)
        decompress = zstandard.ZstdDecompressor().decompress
        for payload in table.column("payload"):
            data = decompress(payload.as_py())
            n = int(np.frombuffer(data, np.int64, 1)[0])
            slots = np.frombuffer(data, np.int64, n, 8)
            begin = np.frombuffer(data, np.int32, n, 8 + 8 * n)
            sizes = np.frombuffer(data, np.int32, n, 8 + 12 * n)
            tokens = np.frombuffer(data, dtype, int(sizes.sum()), 8 + 16 * n)
            at = 0
            for slot, left, size in zip((slots - shard * per_shard).tolist(), begin.tolist(), sizes.tolist()):
                out[slot, left : left + size] = tokens[at : at + size]
                at += size
        _store(layout.file(shard), out.tobytes())
        slots = np.arange(shard * per_shard, shard * per_shard + rows)
        return pa.table(
            {
                "sequence": pa.array(permute(slots, sequences, key, inverse=True), pa.int64()),
                "slot": pa.array(slots, pa.int64()),
                "shard": pa.array(np.full(rows, shard), pa.int64()),
                "byte_offset": pa.array((slots % per_shard) * layout.stride, pa.int64()),
                "crc32": pa.array([zlib.crc32(row.tobytes()) for row in out], pa.int64()),
            }
        )

    sent = stored.select("part", "before", "n", "tokens").mapInArrow(cut, "shard long, payload binary")
    result = sent.groupBy("shard").applyInArrow(
        write, "sequence long, slot long, shard long, byte_offset long, crc32 long"
    )
    return result, layout

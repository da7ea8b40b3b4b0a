"""Benchmark decontamination by latent semantic retrieval with subsequence and answer checks."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.session import scratch_path

#: Buckets of hashed words and dimensions of the latent space; their product bounds all matrices.
FEATURES, RANK = 1 << 15, 64
#: Extra columns of the random start and passes of the power iteration.
OVERSAMPLE, PASSES = 8, 2
#: Words in a searched passage, and from one passage to the next.
PASSAGE, STRIDE = 32, 8
#: Least cosine of a candidate in the latent space.
COSINE = 0.78
#: Share of an item's words, in order, that makes a copy; the same for a paraphrase, which must
#: also have this share of the answer.
COPY, PARAPHRASE, ANSWER = 0.75, 0.6, 0.8
#: Items searched for in one pass over the documents.
ITEM_BLOCK = 4096
#: Parts into which a task cuts its sums of the factorisation, so that many tasks add them up.
SUM_PARTS = 32

_PUNCTUATION = bytes(32 if not (chr(b).isalnum() or b >= 128) else b for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split() if text else []


def features(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (FEATURES - 1)


def answer_of(text: str) -> list[bytes]:
    """The words of an item's last sentence, or of its last third if it is one sentence."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if plain_words(s)]
    words = plain_words(text)
    last = plain_words(sentences[-1]) if sentences else []
    return last if len(sentences) > 1 else words[-max(1, len(words) // 3) :]


class Item(NamedTuple):
    item_id: int
    words: list[bytes]
    answer: list[bytes]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """One stored row for each document with a word: ``at``, its features in ascending order (16 bits each), and ``times``,
    how often each occurs (32 bits). Texts are split into words here once, for all sums over documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(features(words), return_counts=True) for words in map(plain_words, batch.column(0).to_pylist()) if words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([side.astype(kind).tobytes() for side in sides], pa.binary())
                 for sides, kind in (([at for at, _ in made], np.uint16), ([times for _, times in made], np.uint32))],
                names=["at", "times"],
            )

    schema = "at binary, times binary"
    store = scratch_path(docs.sparkSession, "word-counts")
    counted = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(count, schema)
    counted.write.option("compression", "zstd").parquet(store)
    return docs.sparkSession.read.schema(schema).parquet(store)


def document_frequencies(docs: DataFrame, text: str, counted: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and how many documents have a word.

    Tasks sum what they read of ``counted`` (the ``word_counts`` of ``docs``); FEATURES numbers come to the driver, whatever
    the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for found in batch.column(0).to_pylist():
                total[np.frombuffer(found, np.uint16)] += 1
            total[FEATURES] += batch.num_rows
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["feature", "n"])

    counted = word_counts(docs, text) if counted is None else counted
    rows = counted.select("at").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    out = np.zeros(FEATURES + 1, np.int64)
    out[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return out[:FEATURES], int(out[FEATURES])


def weigh(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequency of each feature."""
    return np.log((documents + 1) / (frequency + 1)).astype(np.float32) + np.float32(0.01)


def accumulate(at: np.ndarray, times: np.ndarray, idf: np.ndarray, matrix: np.ndarray, out: np.ndarray) -> None:
    """Add a'(a matrix) to ``out``, where a is the TF-IDF vector, scaled to length 1, of a text that has features ``at`` so many ``times``."""
    row = times * idf[at]
    row /= np.linalg.norm(row) or 1
    sums = np.multiply.outer(row, row @ matrix.take(at, 0))
    sums += out.take(at, 0)
    out[at] = sums


def product(texts: list[np.ndarray], idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'(A matrix), where the rows of A are the vectors of texts."""
    out = np.zeros_like(matrix)
    for found in texts:
        accumulate(*np.unique(found, return_counts=True), idf, matrix, out)
    return out


def _sums(part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])


def factorise(
    docs: DataFrame, text: str, items: list[Item], idf: np.ndarray, documents: int, counted: DataFrame | None = None
) -> np.ndarray:
    """Right singular vectors (FEATURES x RANK) of the TF-IDF matrix of documents, by a randomised SVD.

    The rows are all ``documents`` that have words, each with all of them, and the items, which together weigh as much. A random
    start is multiplied PASSES times by A'A, a distributed product: one task per core sums its share of the documents, SUM_PARTS
    tasks add these sums, and the driver makes the columns orthonormal again. What is shuffled follows the cores, what the
    driver gets is one matrix, whatever the input. All passes read ``counted``, the ``word_counts`` of ``docs``.
    """
    random = np.random.default_rng(23)
    basis = random.standard_normal((FEATURES, RANK + OVERSAMPLE), np.float32)
    context = docs.sparkSession.sparkContext
    whole = (word_counts(docs, text) if counted is None else counted).coalesce(context.defaultParallelism)
    own = [features(i.words) for i in items if i.words]
    schema, high = "part int, sums binary", FEATURES // SUM_PARTS

    for _ in range(PASSES):
        shared = context.broadcast((idf, basis))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, matrix = shared.value
            total = np.zeros_like(matrix)
            for batch in batches:
                for at, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    accumulate(np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(times, np.uint32), weights, matrix, total)
            for part in range(SUM_PARTS):
                yield _sums(part, total[part * high : (part + 1) * high])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                    totals[part] = totals.get(part, 0.0) + np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64)
            for part, sums in totals.items():
                yield _sums(part, sums.astype(np.float32))

        summed = whole.mapInArrow(multiply, schema).repartition(SUM_PARTS, "part").mapInArrow(add, schema)
        total = product(own, idf, basis) * np.float32(max(1.0, documents / max(1, len(own))))
        for part in summed.toLocalIterator():
            total[part.part * high : (part.part + 1) * high] += np.frombuffer(part.sums, np.float32).reshape(high, -1)
        basis = np.linalg.qr(total)[0].astype(np.float32)
        shared.destroy()
    # the singular vectors within the span: rotate by those of the projected products
    small = basis.T @ total
    values, vectors = np.linalg.eigh((small @ small.T).astype(np.float64))
    order = np.argsort(values)[::-1][:RANK]
    return (basis @ vectors[:, order]).astype(np.float32)


def common_subsequence(item: list[bytes], region: list[bytes]) -> int:
    """Length of the longest common subsequence, with a bit for each word of the item."""
    where: dict[bytes, int] = {}
    for at, word in enumerate(item):
        where[word] = where.get(word, 0) | (1 << at)
    full = (1 << len(item)) - 1
    row = full
    for word in region:
        match = where.get(word)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


class Index(NamedTuple):
    """Word vectors (IDF times singular vectors, and a last one of zeros) and the items' latent vectors."""

    vectors: np.ndarray
    items: list[Item]
    latent: np.ndarray


def index_items(items: list[Item], idf: np.ndarray, singular: np.ndarray) -> Index:
    vectors = idf[:, None] * singular
    latent = np.zeros((len(items), singular.shape[1]), np.float32)
    for at, item in enumerate(items):
        if item.words:
            latent[at] = vectors[features(item.words)].sum(0)
            latent[at] /= np.linalg.norm(latent[at]) or 1
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)]).astype(np.float32, copy=False)
    return Index(padded, items, latent)


def candidates(words: list[bytes], index: Index) -> list[tuple[int, int, int, float]]:
    """(item, first and last word, cosine) of runs of passages, of PASSAGE words and STRIDE apart,
    that are at least COSINE alike to an item in the latent space; the cosine is the run's best."""
    found = features(words)
    blocks = max(PASSAGE, len(found) + -len(found) % STRIDE) // STRIDE
    padded = np.full(blocks * STRIDE, FEATURES)  # the vector after the last feature is zero
    padded[: len(found)] = found
    padded = padded.reshape(blocks, STRIDE)
    sums = index.vectors.take(padded[:, 0], 0)
    for k in range(1, STRIDE):
        sums += index.vectors.take(padded[:, k], 0)
    wide = PASSAGE // STRIDE
    passages = sums[: blocks - wide + 1].copy()
    for k in range(1, wide):
        passages += sums[k : k + len(passages)]
    lengths = np.sqrt(np.einsum("ij,ij->i", passages, passages))
    products = index.latent @ passages.T
    hits = np.flatnonzero(products >= np.float32(COSINE) * np.maximum(lengths, 1e-12))
    if not len(hits):
        return []
    runs: list[list] = []
    at, starts = np.divmod(hits, len(passages))
    values = products.ravel()[hits] / np.maximum(lengths[starts], 1e-12)
    for item, start, value in zip(at.tolist(), (starts * STRIDE).tolist(), values.tolist()):
        if runs and runs[-1][0] == item and start - runs[-1][2] <= STRIDE:
            runs[-1][2] = start
            runs[-1][3] = max(runs[-1][3], value)
        else:
            runs.append([item, start, start, value])
    return [(item, first, last + PASSAGE, value) for item, first, last, value in runs]


def find_leaks(text: str | None, index: Index) -> list[tuple[int, float, float, float, str]]:
    """(item_id, cosine, share of the item, share of the answer, kind) for the items in a text."""
    best: dict[int, tuple] = {}
    words = plain_words(text)
    # long texts in blocks that overlap by two passages, so that memory is bounded
    block = 50_000
    for base in range(0, max(1, len(words)), block):
        part = words[base : base + block + 2 * PASSAGE]
        if not part:
            continue
        for at, start, end, cosine in candidates(part, index):
            item = index.items[at]
            n = len(item.words)
            region = words[max(0, base + start - n) : base + end + n]
            share = common_subsequence(item.words, region) / n
            if share < PARAPHRASE:
                continue
            answer = common_subsequence(item.answer, region) / max(1, len(item.answer))
            kind = "copy" if share >= COPY else "paraphrase" if answer >= ANSWER else None
            if kind and (at not in best or best[at][:2] < (share, answer)):
                best[at] = (share, answer, cosine, kind)
    return [(index.items[at].item_id, b[2], b[0], b[1], b[3]) for at, b in sorted(best.items())]


def contaminated(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """One row for each document and benchmark item that it contains: ``doc_id``, ``item_id``,
    ``cosine`` (in the latent space), ``lcs`` and ``answer`` (shares of words in order), ``kind`` and
    ``digest`` (MD5 of the text, which tells rows of one id apart).

    Passages of all documents are compared with all items in a latent space: TF-IDF with document
    frequencies over all documents, projected on the singular vectors of ``factorise``. Pairs of at
    least COSINE are checked on the words around the passage: the longest common subsequence must
    hold COPY of the item's words, or PARAPHRASE of them and ANSWER of the item's answer (its last sentence
    or third). Case and ASCII punctuation don't count.

    Texts are split into words twice: once for the stored ``word_counts``, which the frequencies and all passes of the
    factorisation read, and once for the search. The items are the stated query set: they are searched for in blocks of ITEM_BLOCK,
    each a pass over the documents without a shuffle. A null or empty text has no leaks, an item without words is never found.
    Repeated rows give repeated results. An empty table of documents or items gives an empty result. Only the
    named columns are read; ids must be integers.
    """
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double, kind string, digest string"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    block: list[Item] = []
    blocks = []
    ordered = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    for row in ordered.toLocalIterator():
        words = plain_words(row.t)
        if words:
            block.append(Item(row.i, words, answer_of(row.t)))
        if len(block) == ITEM_BLOCK:
            blocks.append(block)
            block = []
    blocks += [block] if block else []
    if not blocks:
        return rows.sparkSession.createDataFrame([], schema)
    counted = word_counts(rows, "text")
    frequency, documents = document_frequencies(rows, "text", counted)
    idf = weigh(frequency, documents)
    out = None
    for block in blocks:
        singular = factorise(rows, "text", block, idf, documents, counted)
        shared = rows.sparkSession.sparkContext.broadcast(index_items(block, idf, singular))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                made = [
                    (doc, *leak, hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest())
                    for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for leak in find_leaks(t, index)
                ]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)],
                    names=["doc_id", "item_id", "cosine", "lcs", "answer", "kind", "digest"],
                )

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out

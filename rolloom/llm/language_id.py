"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets into which byte n-grams are hashed; with the code length it bounds the model's size.
BUCKETS = 1 << 15
#: n-gram lengths in bytes.
ORDERS = (2, 3, 4)
#: Most languages that a model may have; fitting raises an error beyond.
MOST_LANGUAGES = 256
#: Texts for which the bit classifiers are applied together.
BLOCK = 128
UNDETERMINED = "und"

_SEEDS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
_LETTER = np.full(256, 32, np.uint8)
for _byte in range(256):
    if 97 <= _byte <= 122 or _byte >= 128:
        _LETTER[_byte] = _byte


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's byte n-grams occur in the lower-cased text; all but letters are spaces."""
    data = _LETTER[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))]  # one space at a time
    data = np.concatenate(([32], data, [32])).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for order in ORDERS:
        n = len(data) - order + 1
        if n > 0:
            packed = data[:n].copy()
            for k in range(1, order):
                packed = (packed << np.uint32(8)) | data[k : k + n]
            hashed = (packed * np.uint32(_SEEDS[order])) >> np.uint32(32 - 15)
            counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def codewords(count: int, length: int | None = None) -> np.ndarray:
    """A matrix of +1 and -1 with a row for each of ``count`` classes.

    Up to 7 classes take all their 2^(count-1) - 1 splits, the exhaustive code, in which any two
    rows differ in half of the columns or more; beyond, columns are random splits from a fixed seed, and of 200 such
    codes the one with the largest least distance between rows is taken.
    """
    if count < 2:
        return np.ones((count, 1), np.int8)
    if count <= 7 and length is None:
        splits = np.arange(1, 1 << (count - 1))
        bits = (splits[None, :] >> np.arange(count - 1)[:, None]) & 1
        return np.vstack([np.zeros(len(splits), int), bits]).astype(np.int8) * 2 - 1
    length = length or max(15, int(np.ceil(10 * np.log2(count))))
    best, most = None, -1
    random = np.random.default_rng(17)
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (count, length))
        wide = code.astype(int)
        distance = (length - wide @ wide.T) // 2
        np.fill_diagonal(distance, length)
        if distance.min() > most:
            best, most = code, int(distance.min())
    return best


class Model(NamedTuple):
    """Languages, their codewords, and for each bit the weights, the bias and the weight of its loss."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def fit(docs: DataFrame, text: str, lang: str) -> Model:
    """Learn from every row whose text has a letter and whose language is not null.

    n-gram counts are summed per language inside each task, so a task emits at most one row per
    language and bucket, whatever the share of one language; the sums, at most MOST_LANGUAGES x
    BUCKETS numbers, come to the driver. For each bit of the code a binary naive Bayes classifier
    tells the languages whose codeword has the bit from the others, with add-one smoothing and both
    sides scaled alike. The loss of a bit weighs as much as its two sides differ (the symmetric
    divergence of their gram distributions), so bits that tell little count little.
    """
    schema = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(t):
                    if name not in sums:
                        if len(sums) >= MOST_LANGUAGES:
                            raise ValueError(f"more than {MOST_LANGUAGES} languages")
                        sums[name] = np.zeros(BUCKETS, np.int64)
                    sums[name] += gram_counts(t)
        for name, total in sums.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(count, schema)
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(names), BUCKETS))
    index = {name: at for at, name in enumerate(names)}
    at = np.fromiter((index[x] for x in rows.column("lang").to_pylist()), np.int64, rows.num_rows)
    table[at, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return from_counts(names, table)


def from_counts(names: list[str], table: np.ndarray) -> Model:
    """The model for counts of languages x BUCKETS; each language counts alike, however frequent."""
    if not names:
        return Model([], np.ones((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    share = (table + 1.0) / (table + 1.0).sum(1, keepdims=True)
    code = codewords(len(names))
    weights, trust = np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        plus, minus = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(plus) and len(minus):
            p, q = plus.mean(0), minus.mean(0)
            odds = np.log(p) - np.log(q)
            weights[:, bit] = odds
            trust[bit] = ((p - q) * odds).sum()
    return Model(names, code, weights, trust / trust.sum())


def decode(model: Model, counts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (index), its score and the gap to the next for each row of ``counts``.

    A bit's margin is the mean log-odds per gram, times the square root of the number of grams, so
    that long texts are surer. A codeword's loss is the mean over bits of log(1 + exp(-margin)),
    signed by the codeword and weighed by trust. The nearest codeword has the least loss; the score is
    the share of exp(-loss x bits) that it takes among all languages.
    """
    margins = (counts.astype(np.float32) @ model.weights) / np.sqrt(np.maximum(grams, 1))[:, None]
    signed = margins[:, None, :] * model.code[None, :, :]
    losses = (np.logaddexp(0, -signed) * model.trust).sum(2)
    shares = np.exp(-(losses - losses.min(1, keepdims=True)) * model.code.shape[1])
    shares /= shares.sum(1, keepdims=True)
    order = np.sort(shares, 1)
    gap = order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0)
    return losses.argmin(1), order[:, -1], gap


def predict(docs: DataFrame, text: str, model: Model, ambiguous_below: float = 0.1) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    A null text, one without a letter, or a model without languages gives ``und`` with score 0, and
    ambiguous. A text is ambiguous if the scores of its two nearest codewords differ by less than
    ``ambiguous_below``. The whole text counts. Equal texts get equal results. Input columns of the
    result's names are replaced. The model (buckets x bits floats) travels with the task.
    """
    made = ["lang_pred", "score", "ambiguous"]
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept)
    at = kept.index(text)
    schema = T.StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            unsure = np.ones(len(texts), bool)
            todo = [i for i, t in enumerate(texts) if known.languages and has_letter(t)]
            for first in range(0, len(todo), BLOCK):
                block = todo[first : first + BLOCK]
                counts = np.stack([gram_counts(texts[i]) for i in block])
                best, score, gap = decode(known, counts, counts.sum(1))
                scores[block], unsure[block] = score, gap < ambiguous_below
                for i, b in zip(block, best):
                    names[i] = known.languages[b]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text, mod ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))

"""Alignment of the tokens of two tokenizers: each distinct text once, pair counts weighted by its copies."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rolloom.llm.texts import Codes
from rolloom.session import materialize, scratch_path

#: Bytes of text whose links share one table of pairs.
BLOCK_BYTES = 4 << 20
#: Segments that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 100_000, 100
#: Segments encoded in one call, and how many of them behind each other in one text.
BATCH, TOGETHER = 2000, 200
#: How the second tokenizer writes a space.
SPACE = "▁"

# A space that no token of either tokenizer joins to what stands before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Where a plain split at spaces would cut elsewhere.
_OTHER_SPACE = re.compile(r"\A | \Z| \s|\s ")


class Tokenizers(NamedTuple):
    """Files that every executor can read: a byte-level BPE (A) and a BPE of pieces with byte fallback (B)."""

    a: str
    b: str


class Segment(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    groups: str
    #: Linked ids as a * (size of B) + b, eight bytes per link.
    pairs: bytes


#: Stands for a segment that its tokens don't spell.
NOTHING = Segment(0, 0, 0, "", b"")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Encodes texts with both tokenizers and links their tokens.

    Neither tokenizer joins a space to a character before it that is not white space: A parts words there, and no
    piece of B holds a space behind another character (checked). So " " + text may be cut before each
    space between two such characters, and a segment has the tokens, groups and links that it has in
    the whole. For the same reason segments that neither begin nor end with white space are encoded many at a time, as one text.
    Segments recur, so their alignments are remembered.
    """

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(files.a), SentencePieceProcessor(model_file=files.b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        spelled = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters.get(c, 63) for c in token) for token in spelled]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.shown = [f"{i}{mark}" for mark in ",|" for i in range(self.n_a)] + [f"{i}{mark}" for mark in ",;\n" for i in range(self.n_b)]
        self.parts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.known: dict[str, Segment | None] = {}

    def cut(self, text: str) -> list[str]:
        """Segments of " " + text, each without its first space."""
        if not self.parts:
            return [text]
        return _CUT.split(text) if _OTHER_SPACE.search(text) else text.split(" ")

    def spelled(self, segments: list[str], a: list[int], b: list[int]) -> list[int] | None:
        """The bytes of each segment behind a space, if both rows of tokens have these bytes and end a token where a segment ends."""
        whole = (" " + " ".join(segments)).encode()
        if not whole == b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]):
            return None
        sizes = [len(s) + 1 for s in segments] if whole.isascii() else [len(s.encode()) + 1 for s in segments]
        for side, ids in ((self.a_sizes, a), (self.b_sizes, b)):
            if len(segments) > 1 and not np.isin(np.cumsum(sizes), np.cumsum(side[ids])).all():
                return None
        return sizes

    def spell(self, groups: list[list[str]]) -> list[tuple[list[int], list[int], list[int]] | None]:
        """Sizes of segments and both rows of tokens, of each group encoded as one text; None where they don't spell its segments."""
        texts = [" ".join(group) for group in groups]
        left = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        made = [(e.ids, b) for e, b in zip(left, self.b.encode(texts, num_threads=1))]
        sizes = [self.spelled(group, *ids) for group, ids in zip(groups, made)]
        return [None if own is None else (own, *ids) for own, ids in zip(sizes, made)]

    def link(self, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[Segment]:
        """All segments (given by their bytes) at once, as they stand behind each other; ``a`` and ``b`` spell them and part where they do."""
        ends_a, ends_b, edges = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(sizes)
        in_a, in_b, in_edges = np.zeros((3, int(edges[-1]) + 1), bool)
        in_a[ends_a] = in_b[ends_b] = in_edges[edges] = True
        counts = [np.diff(np.searchsorted(e, edges, "right"), prepend=0) for e in (ends_a, ends_b)]
        # each stretch between neighbouring ends of either side lies in one token of both: these are the links
        every, common = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        pairs = a[np.searchsorted(ends_a, every)] * len(self.b_bytes) + b[np.searchsorted(ends_b, every)]
        links, groups = (np.diff(np.searchsorted(e, edges, "right"), prepend=0) for e in (every, common))
        # ids in the order of the groups, A before B, each with the mark behind it
        last_a, last_b = in_b[ends_a], in_a[ends_b]
        marked = np.concatenate([a + last_a * self.n_a, 2 * self.n_a + b + (last_b + 0 + in_edges[ends_b]) * self.n_b])
        place = np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1])
        shown = "".join(map(self.shown.__getitem__, marked[np.argsort(place, kind="stable")].tolist())).split("\n")
        data, at = pairs.tobytes(), np.concatenate(([0], np.cumsum(links * 8))).tolist()
        return [
            Segment(*numbers, text, data[at[k] : at[k + 1]])
            for k, (*numbers, text) in enumerate(zip(counts[0].tolist(), counts[1].tolist(), groups.tolist(), shown))
        ]

    def encode(self, segments: list[str]) -> list[Segment | None]:
        """Alignments of segments; None where tokens don't spell their segment."""
        out: list[Segment | None] = [None] * len(segments)
        for at in range(0, len(segments), BATCH):
            some = range(at, min(at + BATCH, len(segments)))
            joined = [k for k in some if self.parts and not (segments[k][:1].isspace() or segments[k][-1:].isspace())]
            groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)] + [[k] for k in sorted({*some} - {*joined})]
            spelled = self.spell([[segments[k] for k in group] for group in groups])
            # a group with a segment that its tokens don't spell is encoded segment by segment
            alone = [[k] for group, ids in zip(groups, spelled) if ids is None and len(group) > 1 for k in group]
            spelled += self.spell([[segments[k]] for k, in alone]) if alone else []
            good = [(group, *ids) for group, ids in zip(groups + alone, spelled) if ids is not None]
            if good:
                order, *numbers = ([i for row in good for i in row[side]] for side in range(4))
                for k, found in zip(order, self.link(*(np.array(n, np.int64) for n in numbers))):
                    out[k] = found
        return out

    def learn(self, segments: list[str]) -> list[Segment | None]:
        """Alignments of distinct segments."""
        known = self.known
        new = [s for s in segments if s not in known]
        fresh = dict(zip(new, self.encode(new)))
        out = [known[s] if s in known else fresh[s] for s in segments]
        if len(known) > REMEMBERED:
            known.clear()
        known.update((s, found) for s, found in zip(segments, out) if len(s) <= LONGEST)
        return out

    def whole(self, text: str) -> Segment | None:
        return self.encode([text])[0]


@functools.lru_cache(maxsize=1)
def _aligner(files: Tokenizers) -> Aligner:
    return Aligner(files)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.astype(np.int32).tobytes() for a in arrays))


def _unpack(payload: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    sizes = np.frombuffer(data, np.int64, int(np.frombuffer(data, np.int64, 1)[0]), 8)
    ends = 8 + 8 * len(sizes) + 4 * np.cumsum(sizes)
    return [np.frombuffer(data, np.int32, n, end - 4 * n).astype(np.int64) for n, end in zip(sizes.tolist(), ends.tolist())]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] numbers), begins[1], ..."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class _Block:
    """Distinct texts that share a table of linked pairs."""

    def __init__(self, aligner: Aligner, texts: list[str], copies: list[int]):
        self.aligner, self.texts = aligner, texts
        codes_of = Codes()
        cut = [list(map(codes_of.__getitem__, aligner.cut(t))) for t in texts]
        found = aligner.learn(list(codes_of))
        lost = {at for at, segment in enumerate(found) if segment is None}
        for at, codes in enumerate(cut):
            if lost and not lost.isdisjoint(codes):  # some bytes differ: judge the text as a whole
                whole = aligner.whole(texts[at])
                cut[at] = [] if whole is None else [len(found)]
                found += [] if whole is None else [whole]
        self.segments, self.cut = found, cut
        *numbers, _, pairs = zip(*(NOTHING if s is None else s for s in found), NOTHING)
        numbers, links = [np.array(n[:-1], np.int64) for n in numbers], np.array([len(p) // 8 for p in pairs[:-1]], np.int64)
        flat = np.frombuffer(b"".join(pairs), np.int64)
        self.pairs, numbered = np.unique(flat, return_inverse=True)
        begins = np.cumsum(links) - links
        sizes = np.array([len(c) for c in cut], np.int64)
        text = np.repeat(np.arange(len(cut)), sizes)
        code = np.fromiter((c for codes in cut for c in codes), np.int64, int(sizes.sum()))
        self.counts = [self._sums(text, values[code]) for values in (*numbers, links)]
        distinct, times = np.unique(text * max(len(found), 1) + code, return_counts=True)
        text, code = np.divmod(distinct, max(len(found), 1))
        held = np.repeat(text, links[code]) * max(len(self.pairs), 1) + numbered[_spread(begins[code], links[code])]
        held.sort()
        owner, pair = np.divmod(held[np.diff(held, prepend=-1) > 0], max(len(self.pairs), 1))
        self.documents = np.bincount(pair, np.array(copies, np.float64)[owner], len(self.pairs)).astype(np.int64)
        per_text = np.bincount(text, minlength=len(cut))
        # codes ascend within a text: their steps pack better
        first = np.cumsum(per_text) - per_text
        steps = np.diff(code, prepend=0)
        steps[first[per_text > 0]] = code[first[per_text > 0]]
        self.payload = _pack(*self.counts, per_text, steps, times, links, numbered)

    def _sums(self, text: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(text, values, len(self.cut)).astype(np.int64)

    def groups(self) -> list[str]:
        return [";".join([self.segments[c].groups for c in codes]) for codes in self.cut]


def _measure(payload: bytes, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> list[np.ndarray]:
    """The four counts of a block's texts, their best links and the sums of their links' pair counts."""
    *counts, per_text, steps, times, links, numbered = _unpack(payload)
    by_pair, is_best = np.zeros((2, int(numbered.max(initial=-1)) + 1), np.int64)
    by_pair[pair], is_best[pair] = count, best
    total = lambda values, sizes: np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(sizes)))])
    ends = np.cumsum(per_text)
    running = np.cumsum(steps)
    before = np.concatenate(([0], running))[ends - per_text]
    codes = running - np.repeat(before, per_text)
    return [*counts, *(total(total(v[numbered], links)[codes] * times, per_text) for v in (is_best, by_pair))]


class Alignment(NamedTuple):
    """``texts``: key, copies, groups. ``measures``: key, n_a, n_b, n_groups, n_links, n_best, count_sum.
    ``pairs``: a, b, documents. Keys are the SHA-256 of the text; both first tables have one row per distinct text."""

    texts: DataFrame
    measures: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, text: str, files: Tokenizers, block_bytes: int = BLOCK_BYTES) -> Alignment:
    """Encode each distinct text with A (behind a space) and B, and link tokens whose byte ranges overlap.

    Where tokens of both end at one byte, a group ends: ``groups`` reads ``a1,a2|b1;a3|b2,b3``. A pair's ``documents`` counts
    the rows of ``docs`` that hold it linked; ``n_best`` counts a text's links whose pair count is the highest of their A id,
    ``count_sum`` adds the pair counts of all its links.

    Texts meet by their full text and are counted there, partly before the shuffle, so a text that a third
    of all rows share is encoded once. Tasks align blocks of some ``block_bytes`` of text and store, in one table, the
    groups of each text, the links of the block in one packed row, and a row per pair that the block holds. Pairs are
    then added up, and each block gets its own pairs' sums back; no vocabulary of pairs is broadcast or held whole.

    Null and empty texts are left out; a text whose tokens do not spell it has zeros and empty groups. Strings of special tokens are
    plain text. Empty table: empty tables. Only the named column is read.
    """
    spark = docs.sparkSession
    distinct = docs.select(F.col(text).alias("text")).where(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, made = _aligner(files), TaskContext.get().partitionId(), 0

        def rows(length: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"key": pa.string(), "copies": pa.int64(), "groups": pa.string(), "keys": pa.binary(), "payload": pa.binary()}
            kinds |= {"pair": pa.int32(), "a": pa.int32(), "b": pa.int32(), "documents": pa.int64()}
            block = pa.array(np.full(length, part << 32 | made))
            return pa.RecordBatch.from_arrays(
                [block, *(columns[c].cast(kind) if c in columns else pa.nulls(length, kind) for c, kind in kinds.items())],
                names=["block", *kinds],
            )

        def flush(texts: list[str], copies: list[int]) -> Iterator[pa.RecordBatch]:
            block = _Block(aligner, texts, copies)
            digests = [hashlib.sha256(t.encode()) for t in texts]
            keys, groups = [d.hexdigest() for d in digests], block.groups()
            for at in range(0, len(texts), 1000):
                some = slice(at, at + 1000)
                yield rows(
                    len(keys[some]), key=pa.array(keys[some]), copies=pa.array(copies[some]), groups=pa.array(groups[some], pa.string())
                )
            joined = b"".join(d.digest() for d in digests)
            yield rows(1, keys=pa.array([joined], pa.binary()), payload=pa.array([block.payload], pa.binary()))
            held = np.nonzero(block.documents)[0]
            for at in range(0, len(held), 50_000):
                some = held[at : at + 50_000]
                a, b = np.divmod(block.pairs[some], len(aligner.b_bytes))
                yield rows(
                    len(some), pair=pa.array(some), a=pa.array(a), b=pa.array(b), documents=pa.array(block.documents[some])
                )

        texts, copies, size = [], [], 0
        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(value)
                copies.append(n)
                size += len(value)
                if size >= block_bytes:
                    yield from flush(texts, copies)
                    texts, copies, size, made = [], [], 0, made + 1
        if texts:
            yield from flush(texts, copies)

    schema = "block long, key string, copies long, groups string, keys binary, payload binary, pair int, a int, b int, documents long"
    store = scratch_path(spark, "aligned")
    distinct.mapInArrow(run, schema).write.option("compression", "zstd").parquet(store)
    stored = lambda: spark.read.schema(schema).parquet(store)

    held = stored().where(F.col("pair").isNotNull()).select("block", "pair", "a", "b", "documents")
    pairs = materialize(held.groupBy("a", "b").agg(F.sum("documents").alias("documents")), "pairs")
    highest = pairs.groupBy("a").agg(F.max("documents").alias("highest"))
    judged = pairs.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).alias("best"))
    back = held.drop("documents").join(judged, ["a", "b"]).select("block", "pair", "documents", "best")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        keys, values = [], [np.empty(0, np.int64)] * len(names)
        if left.num_rows:
            joined = left.column("keys")[0].as_py().hex()
            keys = [joined[at : at + 64] for at in range(0, len(joined), 64)]
            values = _measure(left.column("payload")[0].as_py(), *(right.column(c).to_numpy() for c in ("pair", "documents", "best")))
        return pa.table({"key": pa.array(keys, pa.string()), **{n: pa.array(v, pa.int64()) for n, v in zip(names, values)}})

    packed = stored().where(F.col("payload").isNotNull()).select("block", "keys", "payload")
    measures = packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        measure, "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
    )
    texts = stored().where(F.col("key").isNotNull()).select("key", "copies", "groups")
    return Alignment(texts, measures, pairs)


def per_document(docs: DataFrame, doc_id: str, text: str, measures: DataFrame) -> DataFrame:
    """Every row's id and the columns of ``measures`` (by ``key``) for its text; null where it has none.

    Copies of one text meet that text's single row; adaptive execution splits such a join's larger side.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.col(text), 256).alias("key"))
    return rows.join(measures, "key", "left").drop("key")

"""Vocabulary, tokenization, padding and masking of prompt/completion pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.functions.chat import ChatTemplate
from rolloom.functions.text import tokens
from rolloom.plans.ordered import grouped_rank, hash_chunk
from rolloom.session import scratch_path


def render_chat(
    df: DataFrame, template: ChatTemplate, messages: str = "messages", completion: str = "completion"
) -> DataFrame:
    """Add ``prompt_text`` and ``completion_text``; ``completion`` is a list of messages."""
    return df.withColumns(
        {
            "prompt_text": template.prompt_text(F.col(messages), F.col(completion)),
            "completion_text": template.completion_text(F.col(completion)),
        }
    )


class Dictionary(NamedTuple):
    """Texts as numbers, stored: ``texts`` is (_block, key columns, _codes), ``words`` (_block, _code, token, uses).

    A block is a batch of rows; its codes number its own distinct tokens."""

    texts: DataFrame
    words: DataFrame


def token_dictionary(df: DataFrame, key: Sequence[str], text: str) -> Dictionary:
    """Tokenize every text once; what is left to shuffle are the distinct tokens of each block, not their occurrences.

    A block is what Arrow hands over at a time (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows). A null text has no tokens.
    """
    spark = df.sparkSession
    rows = df.select(*key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_tokens"))
    # every column is null in the rows of the other kind
    fields = rows.columns[:-1]
    schema = T.StructType([T.StructField("_block", T.LongType()), *(T.StructField(c, rows.schema[c].dataType) for c in fields)])
    for name, kind in (("_codes", T.ArrayType(T.IntegerType())), ("_code", T.IntegerType()), ("token", T.StringType()), ("uses", T.LongType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch.column(len(fields))
            flat = lists.flatten().dictionary_encode()
            codes, words = flat.indices.cast(pa.int32()), flat.dictionary.cast(pa.string())
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists))))).astype(np.int32)
            block, rows, kinds = part << 32 | number, len(batch), len(words)
            null = lambda like, size: pa.nulls(size, like.type)
            coded = pa.ListArray.from_arrays(pa.array(ends), codes)
            own = [pa.array(np.full(rows, block)), *(batch.column(i) for i in range(len(fields))), coded]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())], names=schema.names
            )
            uses = np.bincount(codes.to_numpy(zero_copy_only=False), minlength=kinds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(kinds, block)),
                    *(null(batch.column(i), kinds) for i in range(len(fields))),
                    null(coded, kinds),
                    pa.array(np.arange(kinds, dtype=np.int32)),
                    words,
                    pa.array(uses, pa.int64()),
                ],
                names=schema.names,
            )
            number += 1

    path = scratch_path(spark, "coded")
    rows.mapInArrow(run, schema).write.parquet(path)
    stored = lambda: spark.read.schema(schema).parquet(path)
    return Dictionary(
        stored().where("_codes IS NOT NULL").select("_block", *key, "_codes"),
        stored().where("_code IS NOT NULL").select("_block", "_code", "token", "uses"),
    )


def build_vocabulary(words: DataFrame, specials: Sequence[str] = ()) -> DataFrame:
    """``token, token_id, uses`` from (token, uses): specials first, in order; the rest numbered in md5 order."""
    counted = words.groupBy("token").agg(F.sum("uses").alias("uses"))
    special = F.lit(None).cast("bigint")
    for i, name in enumerate(specials):
        special = F.when(F.col("token") == name, F.lit(i).cast("bigint")).otherwise(special)
    rest = counted.where(~F.col("token").isin(*specials)) if specials else counted
    ranked = grouped_rank(
        rest.withColumn("_hash", F.md5("token")), [], ["_hash", "token"], hash_chunk(F.col("_hash")), "token_id"
    )
    numbered = ranked.select("token", (F.col("token_id") - 1 + len(specials)).alias("token_id"), "uses")
    if not specials:
        return numbered
    fixed = counted.select("token", special.alias("token_id"), "uses").where("token_id IS NOT NULL")
    return fixed.unionByName(numbered)


def token_ids(coded: Dictionary, vocabulary: DataFrame, unknown: int = -1, name: str = "ids") -> DataFrame:
    """The key columns and the ids of each text's tokens in order, without added special tokens.

    The words of each block meet the vocabulary (one row per block and token), and each block puts their ids in the places of
    its codes.
    """
    key = coded.texts.columns[1:-1]
    known = coded.words.join(vocabulary.select("token", "token_id"), "token", "left")
    ids = known.select("_block", "_code", F.coalesce("token_id", F.lit(unknown)).cast("int").alias("_id"))
    fields = [coded.texts.schema[c] for c in key]
    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        table = np.full(right.num_rows, unknown, np.int32)
        table[right.column("_code").to_numpy()] = right.column("_id").to_numpy()
        lists = left.column("_codes").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        made = pa.ListArray.from_arrays(pa.array(ends), pa.array(table[codes] if len(codes) else np.empty(0, np.int32), pa.int32()))
        return pa.Table.from_arrays([*(left.column(c) for c in key), made], names=[*key, name])

    return coded.texts.groupBy("_block").cogroup(ids.groupBy("_block")).applyInArrow(place, schema)


def tokenize(
    df: DataFrame, key: Sequence[str], text: str, vocabulary: DataFrame, unknown: int = -1, name: str = "ids"
) -> DataFrame:
    """``token_ids`` of texts met for the first time. Rows of equal ``key`` stay apart."""
    return token_ids(token_dictionary(df, key, text), vocabulary, unknown, name)


def tokenize_with(
    df: DataFrame, text: str, encode: Callable[[list[str]], list[list[int]]], name: str = "ids"
) -> DataFrame:
    """Token ids from a caller's tokenizer, called once for each Arrow batch; a null text has none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            ids = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            present = batch.dropna()
            ids[present.index] = pd.Series(encode(present.tolist()), index=present.index, dtype=object)
            yield ids

    return df.withColumn(name, run(text))


def _with_group_max(
    df: DataFrame, group: Sequence[str], value: Column, name: str, bounded: bool = False
) -> DataFrame:
    if bounded:
        return df.withColumn(name, F.max(value).over(Window.partitionBy(*group)))
    widest = df.groupBy(*group).agg(F.max(value).alias(name))
    return df.join(widest, list(group)) if group else df.withColumn(name, widest.scalar())


def _repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), times.cast("int"))


def pad_left(
    df: DataFrame, group: Sequence[str], ids: str, pad_id: int, mask: str, bounded: bool = False
) -> DataFrame:
    """Pad ``ids`` on the left to the group's longest; ``mask`` is 0 on pads, else 1.

    ``bounded=True`` asserts that group sizes have been checked, so that a plain window does.
    """
    wide = _with_group_max(df, group, F.size(ids), "_width", bounded)
    gap = F.col("_width") - F.size(ids)
    return wide.withColumns(
        {
            mask: F.concat(_repeat(0, gap), _repeat(1, F.size(ids))),
            ids: F.concat(_repeat(pad_id, gap), F.col(ids)),
        }
    ).drop("_width")


def pad_right(
    df: DataFrame, group: Sequence[str], ids: str, pad_id: int, mask: str, bounded: bool = False
) -> DataFrame:
    """Pad ``ids`` on the right to the group's longest; ``mask`` and ``bounded`` as in ``pad_left``."""
    wide = _with_group_max(df, group, F.size(ids), "_width", bounded)
    gap = F.col("_width") - F.size(ids)
    return wide.withColumns(
        {
            mask: F.concat(_repeat(1, F.size(ids)), _repeat(0, gap)),
            ids: F.concat(F.col(ids), _repeat(pad_id, gap)),
        }
    ).drop("_width")


def assemble(df: DataFrame, batch: Sequence[str], pad_id: int, max_seq_len: int | None) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``: prompt then completion, padded right to the
    batch width; if that exceeds ``max_seq_len`` every row keeps its last positions.
    ``first_kept`` is the place that the first kept position had before (0 if nothing was cut).
    """
    joined = df.withColumns(
        {
            "input_ids": F.concat("prompt_ids", "completion_ids"),
            "attention_mask": F.concat("prompt_mask", "completion_mask"),
        }
    )
    wide = _with_group_max(joined, batch, F.size("input_ids"), "_width")
    gap = F.col("_width") - F.size("input_ids")

    def fit(padded: Column) -> Column:
        if max_seq_len is None:
            return padded
        return F.when(F.col("_width") > max_seq_len, F.slice(padded, -max_seq_len, max_seq_len)).otherwise(padded)

    return wide.withColumns(
        {
            "attention_mask": fit(F.concat("attention_mask", _repeat(0, gap))),
            "input_ids": fit(F.concat("input_ids", _repeat(pad_id, gap))),
            "first_kept": F.greatest(F.col("_width") - F.lit(max_seq_len), F.lit(0)) if max_seq_len is not None else F.lit(0),
        }
    ).drop("_width")


def loss_rows(
    sequences: DataFrame, key: Sequence[str], logps: Mapping[str, str], uncut: Sequence[str] = (), advantage: str = "advantage"
) -> DataFrame:
    """One row per position whose token a model predicts: ``key``, ``pos``, ``token``, ``mask``, ``advantage`` and ``logps``.

    ``sequences`` are assembled rows. Position 0 has nothing before it, so rows begin at position 1 and the mask moves along with
    its token. ``logps`` names, for each new column, an array of log-probabilities whose element i belongs to position
    i + 1: of the kept sequence, or, for columns in ``uncut``, of the sequence before its front was cut, as a sampler logged it; those are read
    ``first_kept`` places further on. A null array gives nulls. An array of another length than its
    sequence is an error.
    """
    places = F.size("input_ids") - 1
    entries = {"token": F.slice("input_ids", F.lit(2), F.greatest(places, F.lit(0))), "mask": F.slice("attention_mask", F.lit(2), F.greatest(places, F.lit(0)))}
    for name, column in logps.items():
        first = F.col("first_kept") if name in uncut else F.lit(0)
        fits = F.col(column).isNull() | (F.size(column) == places + first)
        entries[name] = F.when(F.assert_true(fits, F.lit(f"{column} does not fit its sequence")).isNull(), F.slice(column, first + 1, F.greatest(places, F.lit(0))))
    sequences = sequences.where(places > 0).withColumns({f"_{name}": value for name, value in entries.items()})
    position = F.posexplode(F.sequence(F.lit(1), places)).alias("_at", "pos")
    rows = sequences.select(*key, advantage, *[f"_{name}" for name in entries], position)
    return rows.select(*key, "pos", *[F.get(f"_{name}", F.col("_at")).alias(name) for name in entries], F.col(advantage).alias("advantage"))


def mask_truncated(df: DataFrame, eos: int, pad: int) -> DataFrame:
    """Zero the completion mask where the completion ends in neither EOS nor PAD."""
    mask = F.col("completion_mask")
    cut = ~F.coalesce(F.try_element_at("completion_ids", F.lit(-1)).isin(eos, pad), F.lit(False))
    return df.withColumn("completion_mask", F.when(cut, F.transform(mask, lambda _: F.lit(0))).otherwise(mask))


def mask_sum(mask: str) -> Column:
    return F.aggregate(mask, F.lit(0), lambda total, bit: total + bit)


def length_flags(
    df: DataFrame, max_prompt: int | None, max_seq_len: int | None, max_completion: int | None
) -> DataFrame:
    """Add the completion length and flags for over-long padded prompts and completions."""
    limit = max_prompt or max_seq_len
    long_prompt = F.size("prompt_ids") > limit if limit is not None else F.lit(False)
    long_completion = F.size("completion_ids") > max_completion if max_completion else F.lit(False)
    return df.withColumns(
        {
            "completion_length": mask_sum("completion_mask"),
            "prompt_too_long": long_prompt,
            "completion_too_long": long_completion,
        }
    )

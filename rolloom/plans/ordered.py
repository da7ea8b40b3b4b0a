"""Ordered computations (ranks, running values, lags) that survive hot keys.

A plain window puts a whole key into one task. Here every key is cut into
*chunks* by a caller-supplied expression that never decreases along the order
(a minute, ``step div 65536``, a hash prefix ...). Each chunk is handled by a local
window; what a chunk needs from the chunks before it (a count, a sum, a last value)
comes from a table with one pre-aggregated row per (key, chunk). The data is
shuffled once, on (key, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.session import materialize

_KEY, _CHUNK = "_key", "_chunk"
#: Rows of a key that one chunk should hold.
CHUNK_ROWS = 65536
#: Parts that a crowded key is cut into at once, and the size of its sketch (ranks are off by about 1.3 %).
SPLITS, SKETCH = 32, 200
#: Numbers that ``has_crowded_key`` hashes keys to.
HASHED = 1 << 17
_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def seeded_hash(seed: object, *parts: Column | str) -> Column:
    """md5 of ``seed:part:part...``; the source of every random order here."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash_chunk(hashed: Column, digits: int = 4) -> Column:
    """Chunk for an md5 order: its first hex digits, uniform by construction."""
    return F.substring(hashed, 1, digits)


def step_chunk(column: Column | str, size: int = 65536) -> Column:
    """Chunk for an integer order: ``size`` consecutive numbers."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(size))


def time_chunk(column: Column | str, unit: str = "minute") -> Column:
    """Chunk for a time order.

    The chunk table has a row for each key and unit that occur: a unit so fine that most chunks hold one row
    makes it as large as the data, and costs a second full shuffle. One so coarse that a hot key's
    chunk doesn't fit a task is worse. Pass the coarsest unit that bounds the rows of a key.
    """
    return F.date_trunc(unit, column)


def row_chunks(
    df: DataFrame, keys: Sequence[str], by: str, name: str = "_rows_at", rows: int | None = None
) -> tuple[DataFrame, Column | None]:
    """Add ``name`` and give its Column: a chunk for the order ``by`` (integer, date or time) that holds about ``rows`` rows of its key, however dense these lie.

    Keys of at most ``rows`` rows are one chunk. A larger key is cut at quantiles of a sketch of its values, into at most
    ``SPLITS`` parts, and parts that are still too large are cut again. Borders are stored, so every later read sees the same. Equal
    values stay together; nulls come first, as in an ascending order.

    Costs a count per key (partly before the shuffle), and for each further level a sketch of the crowded keys' values. A table
    without crowded keys comes back as it is, with None for the chunk: the functions below then use plain windows, which need neither a
    chunk table nor a second shuffle. Borders number about a ``rows``-th of the rows, and AQE judges how to join them.
    """
    rows = rows or CHUNK_ROWS
    kind = df.schema[by].dataType
    value = F.unix_micros(F.col(by).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(by).cast("bigint")
    key = F.struct(*keys, F.lit(0).alias("_one"))
    out, first = df.withColumn(name, F.lit(0).cast("bigint")), True
    while True:
        numbered = out.select(key.alias(_KEY), F.col(name).alias(_CHUNK), value.alias("_v"))
        counts = numbered.groupBy(_KEY, _CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        crowded = materialize(counts.where((F.col("_n") > rows) & (F.col("_low") < F.col("_high"))), "crowded")
        if crowded.isEmpty():
            return (df, None) if first else (out, F.col(name))
        first = False
        # quantiles are asked for at fixed places; a key that needs fewer parts takes some of them
        places = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
        parts = F.least(F.lit(SPLITS), F.ceil(F.col("_n") / rows))
        chosen = F.transform(F.sequence(F.lit(1).cast("bigint"), parts - 1), lambda i: F.round(i * SPLITS / parts).cast("int"))
        sketches = (
            numbered.where("_v IS NOT NULL")
            .join(crowded, [_KEY, _CHUNK])
            .groupBy(_KEY, _CHUNK, "_n", "_low", "_high")
            .agg(F.kll_sketch_agg_bigint("_v", F.lit(SKETCH)).alias("_sketch"))
        )
        # a border at the least value would cut off nothing
        taken = F.transform(chosen, lambda i: F.element_at("_places", i))
        found = F.filter(F.array_distinct(taken), lambda b: b > F.col("_low"))
        sketches = sketches.withColumn("_places", F.kll_sketch_get_quantile_bigint("_sketch", places))
        borders = materialize(
            sketches.select(_KEY, _CHUNK, F.when(F.size(found) > 0, found).otherwise(F.array("_high")).alias("_borders")), "borders"
        )
        passed = F.size(F.filter("_borders", lambda b: b <= F.col("_v")))
        tagged = out.withColumn(_KEY, key).withColumn(_CHUNK, F.col(name)).withColumn("_v", value)
        out = (
            tagged.join(borders, [_KEY, _CHUNK], "left")
            .withColumn(name, F.col(_CHUNK) * (SPLITS + 1) + F.coalesce(F.when(F.col("_borders").isNotNull(), passed), F.lit(0)))
            .drop(_KEY, _CHUNK, "_v", "_borders")
        )


def has_crowded_key(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> bool:
    """Whether a key holds more than ``rows`` rows; if not, plain windows over it will do.

    Keys are counted together by a hash first, in one narrow pass over ``df`` without a shuffle to speak of. A key is no larger than what it
    is counted with, so only the keys of counts above ``rows`` are looked at one by one.
    """
    rows = rows or CHUNK_ROWS
    numbered = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(HASHED)).alias("_hash"))
    large = materialize(numbered.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select("_hash"), "large")
    if large.isEmpty():
        return False
    counts = numbered.join(large, "_hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.where(F.col("_n") > rows).isEmpty()


def _tag(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    # Structs compare equal also where a field is null, so joining on them loses
    # no rows. With no keys the order is global.
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.withColumn(_KEY, key).withColumn(_CHUNK, F.struct(chunk.alias("at")))


def _before(column: Column, combine: str) -> Column:
    window = Window.partitionBy(_KEY).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return _COMBINE[combine](column).over(window)


def grouped_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column | None,
    name: str = "rn",
) -> DataFrame:
    """Add the 1-based position of each row within its key.

    ``order`` must be total (ties are broken arbitrarily) and ``chunk`` must not
    decrease along it. ``keys=[]`` gives a global position. Here and below a chunk of None says that
    no key is too large for a task.
    """
    if chunk is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    tagged = _tag(df, keys, chunk)
    offsets = (
        tagged.groupBy(_KEY, _CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_skip", F.coalesce(_before(F.col("_n"), "sum"), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(_KEY, _CHUNK).orderBy(*order)
    return (
        tagged.withColumn("_pos", F.row_number().over(local))
        .join(offsets, [_KEY, _CHUNK])
        .withColumn(name, F.col("_skip") + F.col("_pos"))
        .drop(_KEY, _CHUNK, "_pos", "_skip")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column | None,
    values: Mapping[str, tuple[str, Column]],
    include_current: bool = True,
) -> DataFrame:
    """Add running aggregates: ``{new column: (sum|max|min|count, value)}``.

    With ``include_current=False`` the frame ends at the previous row.
    """
    if chunk is None:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        return df.withColumns({name: _LOCAL[kind](value).over(plain) for name, (kind, value) in values.items()})
    tagged = _tag(df, keys, chunk)
    for name, (_, value) in values.items():
        tagged = tagged.withColumn(f"_v_{name}", value)
    totals = tagged.groupBy(_KEY, _CHUNK).agg(
        *[_LOCAL[kind](F.col(f"_v_{name}")).alias(f"_t_{name}") for name, (kind, _) in values.items()]
    )
    carried = totals.select(
        _KEY,
        _CHUNK,
        *[_before(F.col(f"_t_{name}"), kind).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    )
    frame = (
        Window.partitionBy(_KEY, _CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    result = tagged
    for name, (kind, _) in values.items():
        result = result.withColumn(f"_l_{name}", _LOCAL[kind](F.col(f"_v_{name}")).over(frame))
    result = result.join(carried, [_KEY, _CHUNK])
    for name, (kind, _) in values.items():
        local, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("max", "min"):
            merged = F.greatest(local, carry) if kind == "max" else F.least(local, carry)
        else:
            merged = F.coalesce(local + carry, local, carry)
        result = result.withColumn(name, merged)
    unwanted = [f"_{p}_{name}" for name in values for p in "vlc"]
    return result.drop(_KEY, _CHUNK, *unwanted)


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column | None,
    value: Column,
    name: str = "previous",
) -> DataFrame:
    """Add ``value`` of the row before this one within its key (null for the first)."""
    if chunk is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    tagged = _tag(df, keys, chunk).withColumn("_v", value)
    across = Window.partitionBy(_KEY).orderBy(_CHUNK)
    lasts = (
        tagged.groupBy(_KEY, _CHUNK)
        .agg(F.max_by(F.struct("_v"), F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .drop("_last")
    )
    local = Window.partitionBy(_KEY, _CHUNK).orderBy(*order)
    return (
        tagged.withColumn("_lag", F.lag(F.struct("_v")).over(local))
        .join(lasts, [_KEY, _CHUNK])
        .withColumn(name, F.coalesce("_lag", "_carry")["_v"])
        .drop(_KEY, _CHUNK, "_v", "_lag", "_carry")
    )


def trailing_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column | None,
    value: Column,
    rows: int,
    name: str = "trailing_mean",
) -> DataFrame:
    """Add the mean of ``value`` over the last ``rows`` rows of the key, this one included.

    Rows are numbered, cut into blocks much longer than the frame, and the tail
    of each block is copied into the next one, so each block is self-contained.
    """
    if chunk is None:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)
        return df.withColumn(name, F.avg(value).over(plain))
    size = max(rows * 8, 1024)
    numbered = grouped_rank(df, keys, order, chunk, "_rank").withColumn("_v", value)
    block = F.floor((F.col("_rank") - 1) / F.lit(size))
    in_tail = (F.col("_rank") - 1) % F.lit(size) >= size - (rows - 1)
    homes = F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block))
    frame = (
        Window.partitionBy(*keys, "_home").orderBy("_rank").rowsBetween(-(rows - 1), Window.currentRow)
    )
    return (
        numbered.withColumn("_block", block)
        .withColumn("_home", F.explode(homes))
        .withColumn(name, F.avg("_v").over(frame))
        .where(F.col("_home") == F.col("_block"))
        .drop("_rank", "_v", "_block", "_home")
    )


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    name: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """The first ``n`` rows of each key, with their 1-based rank.

    Ranked first within (key, salt), so that a hot key is cut by many tasks and
    only ``n * salts`` of its rows reach the final ranking.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(salts))
    partial = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(partial))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_salt")
        .withColumn(name, F.row_number().over(final))
        .where(F.col(name) <= n)
    )

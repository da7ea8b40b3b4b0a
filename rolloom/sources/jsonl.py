"""JSON-lines training files: scan, line index and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloom.functions.variant import is_blank, strip
from rolloom.session import materialize


def parse_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``parsed`` (VARIANT, null where the text is not valid JSON) and drop blank lines."""
    return df.where(~is_blank(F.col(raw))).withColumn("parsed", F.try_parse_json(strip(F.col(raw))))


def _read_lines(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path, lineSep="\n")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("_metadata.file_block_length").alias("_length"),
            F.monotonically_increasing_id().alias("_id"),
            F.col("value").alias("raw"),
        )
    )


def line_index(spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl", label: str = "line-index") -> DataFrame:
    """A stored row per file block: ``file, _block, _length, _first`` (id of its first line), ``lines`` and ``before`` (lines of the file ahead).

    Built in one narrow pass that moves no line. It serves every scan of the same files under the same split
    settings; ``scan_jsonl`` checks that.
    """
    # Numbering the blocks of a file needs a window per file, over blocks and not lines.
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _read_lines(spark, path, pattern).groupBy("file", "_block", "_length").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("lines")
    )
    return materialize(blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))), label)


def scan_jsonl(
    spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl", index: DataFrame | None = None
) -> DataFrame:
    """One row per non-blank line: ``file, line_no, raw, parsed``.

    ``line_no`` is 1-based within the file and counts blank lines. A task reads a
    block of a file in order, so a line's place in its block is the distance of
    its id from the block's smallest, which ``index`` holds (built here if not given; a given one saves a pass over the
    files). Each line is held against its block's row there: under other splits than the index was built with, some
    line of every moved block falls outside, and the scan fails. Lines are never shuffled for it unless
    the index is too large to broadcast, which is left to AQE to judge.
    """
    index = line_index(spark, path, pattern) if index is None else index
    lines = _read_lines(spark, path, pattern).join(index, ["file", "_block", "_length"], "left")
    place = F.col("_id") - F.col("_first")
    fits = F.coalesce((place >= 0) & (place < F.col("lines")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("the line index does not fit the splits of "), "file")).cast("bigint")
    numbered = lines.select("file", F.when(fits, F.col("before") + place + 1).otherwise(wrong).alias("line_no"), "raw")
    return parse_lines(numbered)


def read_line_range(
    spark: SparkSession, index: DataFrame, file: str, first: int, last: int
) -> DataFrame:
    """Lines ``first`` to ``last`` of one file, numbered with the index of a scan of that file alone; no other file is opened."""
    own = index.where(F.col("file") == file)
    return scan_jsonl(spark, file, "*", own).where(F.col("line_no").between(first, last))


def file_catalog(
    spark: SparkSession,
    uploads_dir: str,
    data_pattern: str = "*.jsonl",
    metadata_pattern: str = "metadata.json",
    upload: str = "*",
) -> DataFrame:
    """One row per upload folder holding both a metadata file and a data file.

    Columns ``id, path, purpose, bytes, created_at, filename, format``. Missing metadata
    fields get the defaults; of several data files the first by path is taken. Where the metadata says that the
    upload has several parts, ``path`` is the folder and ``bytes`` the sum of all. Spark's readers don't list empty files: an upload without
    lines is found if its metadata says that it has parts. ``upload`` restricts the listing to one folder.
    """
    root = uploads_dir.rstrip("/")
    folder = F.element_at(F.split("path", "/"), -2)
    data = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", data_pattern)
        .load(f"{root}/{upload}/")
        .select(
            folder.alias("id"),
            "path",
            F.col("length").alias("bytes"),
            F.floor(F.col("modificationTime").cast("double")).cast("bigint").alias("_mtime"),
            F.element_at(F.split("path", "/"), -1).alias("_name"),
        )
        .groupBy("id")
        .agg(F.min_by(F.struct("path", "bytes", "_mtime", "_name"), "path").alias("f"), F.sum("bytes").alias("_all"))
    )
    meta = (
        spark.read.option("pathGlobFilter", metadata_pattern)
        .schema("purpose string, created_at bigint, filename string, format string, parts int")
        .json(f"{root}/{upload}/", multiLine=True)
        .withColumn("_at", F.col("_metadata.file_path"))
        .withColumn("id", F.element_at(F.split("_at", "/"), -2))
    )
    several = F.col("parts") > 1
    empty = "data-00000.jsonl"
    found = meta.join(data, "id", "left").where(F.col("f").isNotNull() | F.col("parts").isNotNull())
    return found.select(
        "id",
        F.when(several, F.regexp_replace("f.path", "/[^/]+$", ""))
        .otherwise(F.coalesce("f.path", F.regexp_replace("_at", "/[^/]+$", f"/{empty}")))
        .alias("path"),
        F.coalesce("purpose", F.lit("training")).alias("purpose"),
        F.when(several, F.col("_all")).otherwise(F.coalesce("f.bytes", F.lit(0))).alias("bytes"),
        F.coalesce("created_at", "f._mtime").alias("created_at"),
        F.coalesce("filename", "f._name", F.lit(empty)).alias("filename"),
        F.coalesce("format", F.lit("unknown")).alias("format"),
    )

"""Secret scanning with a ledger of what has been scanned: each blob once per rule version."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.session import materialize, scratch_path


class Rule(NamedTuple):
    """A kind of secret. A match counts if group ``group`` of ``pattern`` has ``least`` characters.

    ``quick``: a pattern that every text with a span matches, for a first look; else the pattern.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    quick: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the three base kinds.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16, "[0-9a-f]{16}"),
)
#: Public token formats and key headers, beside the base kinds.
EXTRA_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = (*BASE_RULES, *EXTRA_RULES)

_SPAN = "struct<kind:string,start:int,end:int>"
_LEDGER = f"blob string, rules array<string>, spans array<{_SPAN}>"


def content_address(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points, leftmost and without overlap, end exclusive.

    The text is split at the matches; the lengths of pieces and matches in turn give the starts.
    """
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    both = F.arrays_zip(pieces.alias("gap"), found.alias("hit"), sized.alias("part"))
    both = F.filter(both, lambda x: x["hit"].isNotNull())
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast(f"array<{_SPAN}>").alias("spans"),
    )

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        span = F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end")).cast(_SPAN)
        kept = F.when(F.length(x["part"]) >= rule.least, F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), kept.otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(both, start, step, lambda state: state["spans"])
    # most texts have no match: one quick search spares them the rest
    likely = text.rlike(rule.quick or rule.pattern)
    return F.when(likely, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def read_ledger(spark, path: str) -> DataFrame:
    """All findings so far; a path without a table is an empty ledger."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def scan(paths: DataFrame, path: str, text: str, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings for every row of ``paths``: ``path``, ``blob`` and ``spans`` (sorted array of structs).

    Every row is one version of the text at a path. Its blob is the SHA-256 of the text, null being
    empty. The ledger at ``ledger`` (a Parquet folder that grows by one append for each call) holds,
    for each blob, which rule versions were run and what they found. Blobs are looked up there
    first; only unseen pairs of blob and rule version are scanned, on one representative row per
    blob, so thousands of copies cost one scan. A rule with a new version is a new pair, and findings
    of versions not in ``rules`` are left out. Findings then go back to all rows of a blob.

    Null paths and repeated rows are kept, one result row for each. Empty table: empty result.
    Only the two named columns are read. Shuffled are ids and blob keys, and the texts once, on
    (path, blob), which no group of copies can make hot; the last join is by blob, where Spark may
    split a hot blob. If a run is lost midway, the append did not happen and the next run repeats it.
    """
    spark = paths.sparkSession
    rows = paths.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = materialize(rows.select("path", content_address(F.col("text")).alias("blob")), "blobs")
    order = {rule.key: at for at, rule in enumerate(rules)}
    wanted = F.array(*[F.lit(key) for key in order])

    first = listed.groupBy("blob").agg(F.min("path").alias("path"))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    unseen = (
        first.join(seen, "blob", "left")
        .withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("rules") > 0)
        .select(F.col("path").alias("_path"), F.col("blob").alias("_blob"), "rules")
    )
    texts = rows.withColumn("blob", content_address(F.col("text")))
    chosen = texts.join(
        unseen, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob"))
    )
    none = F.array().cast(f"array<{_SPAN}>")
    found = [
        F.when(F.array_contains("rules", rule.key), rule_spans(F.col("text"), rule)).otherwise(none) for rule in rules
    ]
    scanned = chosen.select("blob", "rules", F.concat(*found).alias("spans"))
    # repeated rows share path and blob, so a representative may come more than once
    scanned.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)

    valid = F.array(*[F.lit(rule.key) for rule in rules])
    per_batch = read_ledger(spark, ledger).where(F.arrays_overlap("rules", valid))
    kinds = {rule.kind: rule.key for rule in rules}
    rank = F.create_map(*[F.lit(x) for at, kind in enumerate(kinds) for x in (kind, at)])
    current = F.create_map(*[F.lit(x) for kind, key in kinds.items() for x in (kind, key)])
    valid_spans = F.filter("spans", lambda s: F.array_contains("rules", current[s["kind"]]))
    by_blob = (
        per_batch.withColumn("spans", valid_spans)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    sortable = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")
        ),
    )
    ordered = F.transform(
        F.array_sort(sortable),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return listed.join(by_blob.withColumn("spans", ordered), "blob").select("path", "blob", "spans")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query_ledger(spark) -> str:
    """A ledger of its own for one run."""
    return scratch_path(spark, "ledger")

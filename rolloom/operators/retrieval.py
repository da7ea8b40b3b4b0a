"""Corpus building, BM25 search and dataset preparation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions.text import terms
from rolloom.plans.ordered import top_rows
from rolloom.session import materialize

Analyze = Callable[[Column], Column]

# Terms that no analyzer and no table of stems may yield: every document counts the first once; its stop words count as the second.
_EVERY_DOCUMENT, _STOP = "\x01document", "\x01stop"
#: Postings of a query's rarest terms that name its first documents, and how many of these get a full score, in multiples of k.
SEED_POSTINGS, SEEDS = 2000, 8
#: Layers of a term's postings; weights lie between 0 and 1.
LAYERS = 16
#: The layers left out can add less than this share of the floor: the more, the fewer postings are looked up, and the more pairs need a full score.
LEFT_OUT = 0.75
#: Scores are rounded to six places: what may round up to the floor counts as reaching it.
SLACK = 2e-6


def build_corpus(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Add ``entry``: title, space-bar-space, then the text parts joined by a space."""
    return df.withColumn("entry", F.concat_ws(" | ", F.col(title), F.array_join(text, " ")))


def _asked(queries: DataFrame, analyze: Analyze, stops: DataFrame | None, stems: DataFrame | None) -> DataFrame:
    """``query_id, term, _asked``: the stems of a query's words that are no stop words, and how often each occurs."""
    words = queries.select("query_id", F.explode(analyze(F.col("text"))).alias("word"))
    if stops is not None:
        words = words.join(stops.select("word"), "word", "left_anti")
    if stems is not None:
        words = words.join(stems.select("word", "stem"), "word", "left")
    term = F.coalesce("stem", "word") if stems is not None else F.col("word")
    return words.groupBy("query_id", term.alias("term")).agg(F.count(F.lit(1)).alias("_asked"))


def _spellings(asked: DataFrame, stops: DataFrame | None, stems: DataFrame | None) -> DataFrame:
    """``word, term``: the words of the corpus that count towards a term some query asks for, towards
    the stop words of a document (if there are any), and the mark of every document."""
    terms_ = asked.select("term").distinct()
    if stems is None:
        words = terms_.select(F.col("term").alias("word"), "term")
    else:
        stemmed = stems.select("word", F.col("stem").alias("term"))
        plain = terms_.select(F.col("term").alias("word"), "term").join(stems.select("word"), "word", "left_anti")
        words = stemmed.join(terms_, "term", "left_semi").select("word", "term").unionByName(plain)
    if stops is not None:
        own = stops.select("word").distinct()
        words = words.join(own, "word", "left_anti").unionByName(own.withColumn("term", F.lit(_STOP)))
    mark = asked.sparkSession.range(1).select(F.lit(_EVERY_DOCUMENT).alias("word"), F.lit(_EVERY_DOCUMENT).alias("term"))
    return words.unionByName(mark)


def term_postings(
    corpus: DataFrame, spellings: DataFrame, analyze: Analyze = terms, k1: float = 0.9, b: float = 0.4
) -> tuple[DataFrame, int]:
    """``term, doc_id, _weight`` of the wanted terms, stored, and the number of documents.

    The corpus is analyzed once. What leaves that pass are the counts of ``spellings`` per document, and one
    count of a mark per document, which carries its length.
    """
    analyzed = corpus.select("doc_id", analyze(F.col("text")).alias("_words"))
    counted = (
        analyzed.select(
            "doc_id", F.size("_words").alias("_len"), F.explode(F.array_append("_words", F.lit(_EVERY_DOCUMENT))).alias("word")
        )
        .join(spellings, "word")
        .groupBy("doc_id", "_len", "term")
        .agg(F.count(F.lit(1)).alias("_tf"))
    )
    counted = materialize(counted, "postings")
    of_stops = F.when(F.col("term") == _STOP, F.col("_tf"))
    every = F.col("term") == _EVERY_DOCUMENT
    totals = counted.agg(F.count_if(every).alias("n"), F.sum(F.when(every, F.col("_len"))).alias("len"), F.sum(of_stops).alias("stops"))
    n, words, stopped = totals.first()  # one row
    length = F.col("_len")
    rows = counted.where(~every & (F.col("term") != _STOP))
    if stopped:  # the lengths need a join, so what it gives is stored
        per_document = counted.where(F.col("term") == _STOP).select("doc_id", F.col("_tf").alias("_stopped"))
        rows = rows.join(per_document, "doc_id", "left")
        length = length - F.coalesce("_stopped", F.lit(0))
    mean = ((words or 0) - (stopped or 0)) / (n or 1) or 1.0
    weight = F.col("_tf") / (F.col("_tf") + k1 * (1 - b + b * length / mean))
    weighed = rows.select("term", "doc_id", weight.alias("_weight"))
    return (materialize(weighed, "weights") if stopped else weighed), n


def _scores(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg(F.sum(F.col("_gain") * F.col("_weight")).alias("_score"))


def scored_candidates(asked: DataFrame, postings: DataFrame, documents: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that can be among the ``k`` best of their query with their full scores, and all pairs looked up on the way.

    1. *Floor.* The rarest terms of a query, up to ``SEED_POSTINGS`` postings, name some documents; the best ``SEEDS`` x k of
       them get their full score, and the k-th best is a floor: nothing below it is among the k best.
    2. *Bounds.* A term's postings lie in layers of like weight, and no document gains more from a layer than the term's gain times the
       layer's greatest weight. Layers are left out, those first that save most postings for what they can add, the low ones of a term before the
       high ones, while all that a document could gain from them stays below the floor. A hit needs a posting of another layer.
    3. *Rest.* The documents of the other layers are looked up. Those that reach the floor if they gain all
       they can from the layers left out get their full score, by joins on (term, document).

    Nothing is estimated: pairs left out have a proven lower score.
    """
    layered = postings.withColumn("_layer", F.floor(F.col("_weight") * LAYERS).cast("int"))
    layers = layered.groupBy("term", "_layer").agg(F.count(F.lit(1)).alias("_n"), F.max("_weight").alias("_most"))
    layers = layers.withColumn("_df", F.sum("_n").over(Window.partitionBy("term")))
    idf = F.log(1 + (F.lit(documents) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    # all windows below belong to a query: one exchange serves them
    gains = asked.join(layers, "term").withColumn("_gain", F.col("_asked") * idf).repartition("query_id")
    rare_first = Window.partitionBy("query_id").orderBy("_df", "term", F.desc("_layer"))
    within = Window.partitionBy("query_id", "term").orderBy("_layer")
    upward = within.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bound = F.col("_gain") * F.col("_most")
    gains = gains.withColumns(
        {
            "_before": F.sum("_n").over(rare_first) - F.col("_n"),
            "_below": F.lag(bound, 1, 0.0).over(within),
            "_saved": F.sum("_n").over(within) / bound,
        }
    )
    # postings saved for each unit of score by the best stretch of a term's layers that ends here or higher
    gains = gains.withColumns({"_worth": F.max("_saved").over(upward), "_cost": bound - F.col("_below")})
    columns = ["query_id", "term", "_layer", "_gain", "_before", "_worth", "_cost", (F.col("_below") == 0).alias("_lowest")]
    gains = materialize(gains.select(*columns), "gains")
    terms_of = gains.where("_lowest").select("query_id", "term", "_gain")
    best = [F.col("_score").desc(), F.col("doc_id")]

    seeds = gains.where(F.col("_before") < SEED_POSTINGS).select("query_id", "term", "_layer", "_gain").join(layered, ["term", "_layer"])
    chosen = top_rows(_scores(seeds), ["query_id"], best, SEEDS * k, "_place").select("query_id", "doc_id")
    full = _scores(chosen.join(terms_of, "query_id").join(postings, ["term", "doc_id"]))
    leading = top_rows(full, ["query_id"], best, k, "_place").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_found"), F.min("_score").alias("_floor")
    )
    floors = leading.where(F.col("_found") == k).select("query_id", (F.col("_floor") - SLACK).alias("_floor"))

    saving = Window.partitionBy("query_id").orderBy(F.desc("_worth"), "term", "_layer")
    whole, term = Window.partitionBy("query_id"), Window.partitionBy("query_id", "term")
    judged = gains.join(floors, "query_id", "left").repartition("query_id").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)))
    judged = judged.withColumn("_out", F.sum("_cost").over(saving) < LEFT_OUT * F.col("_floor"))
    lost = F.when(F.col("_out"), F.col("_cost")).otherwise(0.0)
    judged = judged.withColumn("_need", F.col("_floor") - F.sum(lost).over(whole)).withColumn("_lost", F.sum(lost).over(term))
    deciding = judged.where(~F.col("_out")).select("query_id", "term", "_layer", "_gain", "_lost", "_need")

    # few rows meet many here; a frequent layer's postings are a skewed side that AQE splits
    met = layered.join(deciding, ["term", "_layer"]).groupBy("query_id", "doc_id", "_need")
    looked_up = met.agg(F.sum(F.col("_gain") * F.col("_weight") - F.col("_lost")).alias("_sure"))
    able = looked_up.where(F.col("_sure") >= F.col("_need")).select("query_id", "doc_id")
    return _scores(able.join(terms_of, "query_id").join(postings, ["term", "doc_id"])), looked_up


def bm25_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    k1: float = 0.9,
    b: float = 0.4,
    analyze: Analyze = terms,
    stops: DataFrame | None = None,
    stems: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best documents of each query: ``query_id, doc_id, score, rank``.

    ``corpus`` is (doc_id, text), ``queries`` (query_id, text). A term of a query counts as
    often as it occurs there. Of hits with the same text only the best is kept, so
    fewer than k may remain. Documents sharing no term with a query are not hits.

    ``stops`` (word) lists words that count neither as terms nor towards a document's length; ``stems`` (word,
    stem) gives words the term they stand for, others stand for themselves. Both are joined: the corpus meets only those
    spellings that some query asks for. Scores are exact; see ``scored_candidates`` for how few pairs need one.
    """
    asked = materialize(_asked(queries, analyze, stops, stems), "asked")
    postings, documents = term_postings(corpus, _spellings(asked, stops, stems), analyze, k1, b)
    scored, _ = scored_candidates(asked, postings, documents, k)
    rounded = scored.select("query_id", "doc_id", F.round("_score", 6).alias("score"))
    best = materialize(top_rows(rounded, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, "rank"), "best")
    hits = corpus.join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = hits.select("doc_id", F.md5("text").alias("_same"))
    return (
        best.join(texts, "doc_id")
        .groupBy("query_id", "_same")
        .agg(F.min_by(F.struct("doc_id", "score", "rank"), "rank").alias("hit"))
        .select("query_id", "hit.*")
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], predicate: Column) -> DataFrame:
    """Of the rows that satisfy ``predicate``, the first of each key in ``order``."""
    others = [c for c in df.columns if c not in key]
    return (
        df.where(predicate)
        .groupBy(*key)
        .agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
        .select(*key, "_first.*")
    )


def decode_labels(
    df: DataFrame, names: Mapping[int, str] | DataFrame, allowed: DataFrame | None, order: Sequence[str], n: int | None
) -> DataFrame:
    """Replace an integer ``label`` by its name, keep allowed names, take the first ``n`` in order.

    Names given as a mapping become a literal, so decoding needs no join; a table of
    names (``label, name``) is joined. Rows whose label has no name are left out.
    """
    if isinstance(names, DataFrame):
        decoded = df.join(names, "label").drop("label").withColumnRenamed("name", "label")
    else:
        literal = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
        decoded = df.withColumn("label", F.try_element_at(literal, F.col("label"))).where("label IS NOT NULL")
    if allowed is not None:
        decoded = decoded.join(allowed.select("label"), "label", "left_semi")
    return decoded.orderBy(*order).limit(n) if n is not None else decoded

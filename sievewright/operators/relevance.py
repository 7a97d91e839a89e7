"""TF-IDF scores of a document's segments and selections under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import reading
from ..functions.words import STOPWORDS
from .batches import by_document

_WORD = r"\p{Alpha}[\p{Alpha}']*"


def score_words(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, index, word): every word that counts, as often as it occurs."""
    found = F.filter(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), lambda w: F.length(w) > 2)
    return segments.select(key, "index", F.explode(found).alias("w")).select(key, "index", F.lower("w").alias("word")).where(~F.col("word").isin(*sorted(STOPWORDS)))


def term_frequency(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    return score_words(segments, key).groupBy(key, "index", "word").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    return term_frequency(segments, key).groupBy(key, "word").agg(F.count(F.lit(1)).alias("df"))


def score_segments(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, index, score): the mean idf of a segment's words among its document's segments; no words: 0."""

    def scored(texts: list[str]) -> tuple[range, list[float]]:
        return range(len(texts)), reading.scores(texts)

    return by_document(segments, key, ("text",), scored, (key, "index"), "score double")


def greedy_keep(items: Column, budget: Column) -> Column:
    """The places of array<struct<..., place, cost>> taken in order while they fit; one that doesn't is skipped."""
    start = F.struct(budget.cast("long").alias("left"), F.array().cast("array<int>").alias("kept"))

    def take(s: Column, x: Column) -> Column:
        took = F.struct((s["left"] - x["cost"]).alias("left"), F.array_append(s["kept"], x["place"]).alias("kept"))
        return F.when(x["cost"] <= s["left"], took).otherwise(s)

    return F.aggregate(items, start, take, lambda s: s["kept"])


def select_by_score(segments: DataFrame, budget: int, scores: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The segments kept under the budget, best score first and earlier first among equals; (key, index, score) rows
    can be given in place of TF-IDF scores, where a segment without one scores 0."""
    if scores is None:

        def chosen(index: list[int], tokens: list[int], texts: list[str]) -> tuple[list[int]]:
            return (reading.best([reading.Segment(i, "", 0, 0, n, x) for i, n, x in zip(index, tokens, texts)], budget),)

        return by_document(segments, key, ("index", "tokens", "text"), chosen, segments.columns)
    scored = segments.select(key, "index", "tokens").join(scores.select(key, "index", "score"), [key, "index"], "left")
    order = -F.coalesce("score", F.lit(0.0))
    items = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.col("index").alias("place"), F.col("tokens").cast("long").alias("cost"))))
    kept = scored.groupBy(key).agg(items.alias("items")).select(key, F.explode(greedy_keep(F.col("items"), F.lit(budget))).alias("index"))
    return segments.join(kept, [key, "index"], "left_semi").select(*segments.columns)


def head_tail(segments: DataFrame, budget: int, head_ratio: float = 0.5, key: str = "doc_id") -> DataFrame:
    """The longest beginning within budget * head_ratio (rounded half to even) and the longest end, of what is left,
    within the rest of the budget; both stop at the first segment that doesn't fit."""
    head = round(budget * head_ratio)
    tail = max(budget - head, 0)
    up, down = (W.partitionBy(key).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.col("index"), F.col("index").desc()))
    marked = segments.withColumn("_head", F.sum("tokens").over(up) <= head).withColumn("_tail", F.sum("tokens").over(down) <= tail)
    return marked.where("_head or _tail").select(*segments.columns)

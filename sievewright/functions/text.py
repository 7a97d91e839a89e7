"""Column builders for estimated token counts, truncation, words and shingles.

Estimates and truncation depend on the order in which doubles are added, so they run over Arrow batches; the others are
built-in expressions. ``register`` gives SQL the same functions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import reading
from .words import CJK, SPACE

# an apostrophe inside a word counts as a letter; writing it as one leaves a pattern without a repeated group
_INNER_APOSTROPHE = "(?<=[A-Za-z])['\u2019](?=[A-Za-z])"
_RUNS = rf"\n+|[A-Za-z]+|[0-9]+|[{CJK}]+|[^ \t\r\f\x0B]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def runs(text: Column | str) -> Column:
    """The runs of a text that cost anything, in order: array<string>."""
    return F.regexp_extract_all(F.regexp_replace(_col(text), _INNER_APOSTROPHE, "x"), F.lit(_RUNS), F.lit(0))


def _estimated(text: pa.Array) -> pa.Array:
    return pa.array(reading.tokens_of([t or "" for t in text.to_pylist()]), pa.int32())


def _truncated(text: pa.Array, budget: pa.Array, suffix: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (text, budget, suffix)))
    return pa.array([None if t is None or n is None else reading.truncate(t, n, s or "") for t, n, s in rows], pa.string())


def _arrow(f: Callable[..., pa.Array], kind: str):
    return F.arrow_udf(f, kind)


def estimate_tokens(text: Column | str) -> Column:
    """Estimated tokens of a text: its runs' costs, added from left to right in doubles, rounded up. Null: 0."""
    return _arrow(_estimated, "int")(_col(text))


def fits_budget(text: Column | str, budget: int | Column) -> Column:
    return estimate_tokens(text) <= budget


def truncate_to_tokens(text: Column | str, budget: int | Column, suffix: str = "") -> Column:
    """The text if it fits, else a prefix found by halving, trimmed, and the suffix; nothing if there is no room.

    Costs aren't monotone in the prefix, so the halving itself is what is defined.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return _arrow(_truncated, "string")(_col(text), budget.cast("long"), F.lit(suffix))


def words(text: Column | str) -> Column:
    """Lower-case runs of anything but white space."""
    # ! to ~ are none; named first, they spare most characters a look through all ranges of white space
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(rf"[!-~[^{SPACE}]]++"), F.lit(0))


def shingles(text: Column | str, size: int = 5) -> Column:
    """The distinct runs of ``size`` words, joined by spaces; all words if there are no more than that; none: empty."""
    if size < 1:
        raise ValueError("shingle_size must be at least 1")

    if size == 1:
        return F.array_distinct(words(text))

    def cut(w: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(size)))))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= size, F.array(F.array_join(w, " "))).otherwise(many)

    return F.transform(F.array(words(text)), cut)[0]


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Similarity of two distinct arrays: shared in all; two empty ones 1, one empty 0."""
    a, b = _col(a), _col(b)
    shared = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n))[0]  # one intersection
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared)


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL: estimate_tokens(text), fits_budget(text, budget), text_words(text),
    text_shingles(text, size), jaccard(a, b) and truncate_to_tokens(text, budget, suffix)."""

    def some_shingles(text: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([None if t is None else reading.shingles(t, n) for t, n in zip(text.to_pylist(), size.to_pylist())], pa.list_(pa.string()))

    def some_words(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else reading.words(t) for t in text.to_pylist()], pa.list_(pa.string()))

    for name, f, kind in (("estimate_tokens", _estimated, "int"), ("truncate_to_tokens", _truncated, "string"), ("text_words", some_words, "array<string>"), ("text_shingles", some_shingles, "array<string>")):
        spark.udf.register(name, _arrow(f, kind))
    spark.sql("create or replace temporary function fits_budget(t string, budget int) returns boolean return estimate_tokens(t) <= budget")
    shared = "size(array_intersect(a, b))"
    likeness = f"case when size(a) = 0 and size(b) = 0 then 1D when size(a) = 0 or size(b) = 0 then 0D else {shared} / (size(a) + size(b) - {shared}) end"
    spark.sql(f"create or replace temporary function jaccard(a array<string>, b array<string>) returns double return {likeness}")

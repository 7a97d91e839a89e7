"""The document pipeline: segments, stages from left to right, reassembly with markers, and a last cut to the budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import reading
from ..functions.text import estimate_tokens, truncate_to_tokens
from ..operators.batches import pieces
from ..operators.neardup import dedupe_segments
from ..operators.relevance import head_tail, select_by_score
from ..operators.segments import SEPARATOR, split_segments

#: A stage takes the segments left and the options, and returns those that stay.
Stage = Callable[..., DataFrame]


def _dedupe(segments: DataFrame, *, jaccard: float, shingle_size: int, key: str, **_: object) -> DataFrame:
    return dedupe_segments(segments, jaccard, shingle_size, key)


def _score(segments: DataFrame, *, budget: int, key: str, **_: object) -> DataFrame:
    return select_by_score(segments, budget, key=key)


def _head_tail(segments: DataFrame, *, budget: int, head_ratio: float, key: str, **_: object) -> DataFrame:
    return head_tail(segments, budget, head_ratio, key)


STRATEGIES: dict[str, Stage] = {"dedupe": _dedupe, "score": _score, "head-tail": _head_tail}
_NOTES = {"dedupe": "dedupe dropped %d near-duplicate segment(s)", "score": "score dropped %d segment(s) outside the budget", "head-tail": "head-tail dropped %d segment(s) outside the budget"}


def register_stage(name: str, stage: Stage, note: str = "") -> None:
    """Adds a stage; note, with one %d for the number of dropped segments, is put in the notes if any were."""
    STRATEGIES[name] = stage
    _NOTES[name] = note


def parse_strategy(strategy: str) -> list[str]:
    names = list(filter(None, map(str.strip, strategy.split(","))))
    for n in names:
        if n not in STRATEGIES:
            raise ValueError(f"unknown strategy {n!r} (choose from {', '.join(sorted(STRATEGIES))})")
    return names


def rebuild(kept: Column, total: Column, marker: bool = True) -> Column:
    """The text of array<struct<index, text>>, in order, of segments 0 .. total - 1: with markers where some are gone."""
    if not marker:
        return F.array_join(F.transform(kept, lambda s: s["text"]), SEPARATOR)
    note = lambda n: F.format_string("[%d segments elided]", n)
    before = lambda i: F.coalesce(F.get(kept, i - 1)["index"], F.lit(-1))
    parts = F.transform(kept, lambda s, i: F.when(s["index"] - before(i) > 1, F.concat(note(s["index"] - before(i) - 1), F.lit(SEPARATOR), s["text"])).otherwise(s["text"]))
    after = total - 1 - F.coalesce(F.get(kept, F.size(kept) - 1)["index"], F.lit(-1))
    return F.array_join(F.when(after > 0, F.concat(parts, F.array(note(after)))).otherwise(parts), SEPARATOR)


def squeeze(
    docs: DataFrame,
    budget: int,
    strategy: str = "score",
    head_ratio: float = 0.5,
    jaccard: float = 0.8,
    shingle_size: int = 5,
    marker: bool = True,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, text, original_tokens, final_tokens, segments_in, segments_out, notes) for every document.

    Unknown strategies raise before any work. Built-in strategies take one narrow pass over Arrow batches: no shuffle,
    no cache, and every row, a null key's too, for itself. Registered stages work on DataFrames of segments. The result
    fits a budget of 0 or more; a negative one gives empty texts.
    """
    names = parse_strategy(strategy)
    options = {"budget": budget, "head_ratio": head_ratio, "jaccard": jaccard, "shingle_size": shingle_size}
    if shingle_size < 1 and "dedupe" in names:
        raise ValueError("shingle_size must be at least 1")
    docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    if any(STRATEGIES[n] is not _BUILT_IN.get(n) for n in names):
        return _by_stages(docs, names, marker, key, options)
    schema = StructType([docs.schema[key], *_parse_datatype_string(_RESULT).fields])
    return docs.mapInArrow(_squeezed(names, marker, key, options), schema)


_BUILT_IN = dict(STRATEGIES)
_RESULT = "text string, original_tokens int, final_tokens int, segments_in int, segments_out int, notes array<string>"
_CUT_NOTE = "hard-truncated output to stay within budget"


def _places(name: str, left: list[reading.Segment], budget: int, head_ratio: float, jaccard: float, shingle_size: int) -> list[int]:
    if name == "dedupe":
        gone = reading.repeats([(s.kind, s.text) for s in left], jaccard, shingle_size)
        return [k for k in range(len(left)) if k not in gone]
    return reading.best(left, budget) if name == "score" else reading.ends([s.tokens for s in left], budget, head_ratio)


def _shortened(segments: list[reading.Segment], names: list[str], marker: bool, options: dict) -> tuple[str, int, list[str]]:
    """What the strategies make of a document: the text, the number of segments left, and the notes."""
    left, notes = segments, []
    for name in names:
        stay = [left[k] for k in _places(name, left, **options)]
        if len(stay) < len(left) and _NOTES[name]:
            notes.append(_NOTES[name] % (len(left) - len(stay)))
        left = stay
    parts, before = [], -1
    for index, body in [*((s.index, s.text) for s in left), (len(segments), None)]:
        if marker and index - before > 1:
            parts.append(f"[{index - before - 1} segments elided]")
        if body is not None:
            parts.append(body)
        before = index
    return SEPARATOR.join(parts), len(left), notes


def _squeezed(names: list[str], marker: bool, key: str, options: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    budget, kinds = options["budget"], [pa.string(), *[pa.int32()] * 4, pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            segments = reading.segments_of(texts)
            made = [_shortened(s, names, marker, options) for s in segments]
            rows = []
            for (whole, left, notes), given, n, final in zip(made, reading.tokens_of(texts), map(len, segments), reading.tokens_of([m[0] for m in made])):
                if final > budget:
                    whole, notes = reading.truncate(whole, budget), [*notes, _CUT_NOTE]
                    final = reading.tokens(whole)
                rows.append((whole, given, final, n, left, notes))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], [key, "text", "original_tokens", "final_tokens", "segments_in", "segments_out", "notes"])

    return run


def _by_stages(docs: DataFrame, names: list[str], marker: bool, key: str, options: dict) -> DataFrame:
    """With registered stages, which take and give DataFrames of segments; documents of a null key are one document."""
    budget = options["budget"]
    heads = docs.select(key, estimate_tokens("text").alias("original_tokens"))
    left, dropped = split_segments(docs, key), []
    for k, name in enumerate(names):
        dropped.append(left.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{k}")))
        left = STRATEGIES[name](left, **options, key=key)
    dropped.append(left.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{len(names)}"), F.array_sort(F.collect_list(F.struct("index", "text"))).alias("kept")))
    out = heads
    for d in dropped:
        name = next(c for c in (f"{key}_{k}" for k in range(99)) if c not in out.columns + d.columns)
        out = out.join(d.withColumnRenamed(key, name), F.col(key).eqNullSafe(F.col(name)), "left").drop(name)
    n = [F.coalesce(f"n{k}", F.lit(0)) for k in range(len(names) + 1)]
    out = out.withColumn("segments_in", n[0].cast("int"))
    notes = [F.when(n[k] > n[k + 1], F.format_string(_NOTES[name], n[k] - n[k + 1])) for k, name in enumerate(names) if _NOTES[name]]
    none = F.array().cast("array<struct<index:int,text:string>>")
    out = out.withColumn("whole", rebuild(F.coalesce("kept", none), F.col("segments_in"), marker)).withColumn("whole_tokens", estimate_tokens("whole"))
    over = F.col("whole_tokens") > budget
    notes.append(F.when(over, F.lit(_CUT_NOTE)))
    out = out.withColumn("text", F.when(over, truncate_to_tokens("whole", budget)).otherwise(F.col("whole")))
    final = F.when(over, estimate_tokens("text")).otherwise(F.col("whole_tokens"))
    return out.select(key, "text", "original_tokens", final.alias("final_tokens"), "segments_in", n[-1].cast("int").alias("segments_out"), F.array_compact(F.array(*notes)).alias("notes"))

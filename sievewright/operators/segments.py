"""Segmentation: documents into paragraphs and fenced code blocks, narrow and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import reading
from ..functions.text import estimate_tokens
from ..functions.words import SPACE
from .batches import pieces

SEPARATOR = "\n\n"
#: A segment: its place in the document, kind, 1-based first and last line, estimated tokens and text.
SEGMENT = reading.Segment._fields
_KINDS = dict(zip(SEGMENT, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())))
_FIELDS = "index int, kind string, start_line int, end_line int, tokens int, text string"
_LISTED = f"array<struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>>"


def fence_marker(line: Column) -> Column:
    """``` or ~~~ if the line opens or closes a fence, else an empty string."""
    return F.regexp_extract(line, rf"^[{SPACE}]*(```|~~~)", 1)


def segment(text: Column, index: Column, kind: Column, start_line: Column, end_line: Column) -> Column:
    values = dict(zip(SEGMENT, (index, kind, start_line, end_line, estimate_tokens(text), text)))
    return F.struct(*[c.cast("int" if n not in ("kind", "text") else "string").alias(n) for n, c in values.items()])


def is_code(kind: Column | str = "kind") -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind) == "code"


def _found(text: pa.Array) -> tuple[list[int], list[pa.Array]]:
    """Each text's number of segments, and the segments' fields."""
    found = reading.segments_of([t or "" for t in text.to_pylist()])
    columns = zip(*chain.from_iterable(found)) if any(found) else [[]] * len(_KINDS)
    return [len(f) for f in found], [pa.array(c, t) for c, t in zip(columns, _KINDS.values())]


def _listed(text: pa.Array) -> pa.Array:
    out = []
    for b in pieces([pa.RecordBatch.from_arrays([text], ["text"])]):
        numbers, columns = _found(b.column("text"))
        out.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(numbers)], pa.int32()), pa.StructArray.from_arrays(columns, list(_KINDS))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct(list(_KINDS.items()))))


def with_segments(docs: DataFrame, text: str = "text", out: str = "segments") -> DataFrame:
    """Adds array<struct> of a document's segments; null and blank texts have none.

    A fenced block ends at the next line with its own marker, or at the end; paragraphs are the maximal runs of other
    non-blank lines outside the blocks.
    """
    return docs.withColumn(out, F.arrow_udf(_listed, _LISTED)(F.col(text)))


def split_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a segment: the key, then index, kind, start_line, end_line, tokens, text. Texts are read once, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            numbers, columns = _found(b.column("text"))
            of = pa.array([k for k, n in enumerate(numbers) for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), *columns], [key, *_KINDS])

    schema = StructType([docs.schema[key], *_parse_datatype_string(_FIELDS).fields])
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


def join_segments(segments: DataFrame, key: str = "doc_id", separator: str = SEPARATOR) -> DataFrame:
    """(key, text): each document's segment texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "text")))
    return segments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), separator).alias("text"))

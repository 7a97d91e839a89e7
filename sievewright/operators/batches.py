"""Arrow batches in pieces of bounded size, and one call of a function for all segments of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text, and segments, that are Python objects at once; more only for a single longer text or document.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 2000
#: Rows given for documents that are put together at once; more only as far as one part of a document goes.
PIECE_TAKEN = 20_000


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches, whatever their size, so that no piece has more than ``most`` bytes of text, but for single longer rows."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def _documents(batches: Iterable[pa.RecordBatch], place: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole documents, and where these start and end; a document's rows have the places 1, 2, 3, ..."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        b = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
        return b, np.append(np.flatnonzero(b.column(place).to_numpy() == 1), b.num_rows)

    for b in batches:
        at = 0
        while at < b.num_rows:
            starts = np.flatnonzero(b.column(place).to_numpy()[at:] == 1) + at
            if held and (not len(starts) or starts[0] > at):  # the rest of the last document, or more of it
                held.append(b.slice(at, (starts[0] if len(starts) else b.num_rows) - at))
                at += held[-1].num_rows
                continue
            if held:
                yield whole(held)
                held = []
            # whole documents of up to PIECE_ROWS rows, one at least; the batch's last one may go on
            to = int(starts[max(1, np.searchsorted(starts, at + PIECE_ROWS, "right") - 1)]) if len(starts) > 1 else b.num_rows
            if len(starts) > 1:
                yield whole([b.slice(at, to - at)])
            else:
                held = [b.slice(at)]
            at = to
    if held:
        yield whole(held)


def by_document(segments: DataFrame, key: str, needs: Iterable[str], f: Callable[..., tuple], columns: Iterable[str], more: str = "") -> DataFrame:
    """f over each document's segments by index, in one shuffle by document; a null key is a document as any other.

    f takes lists, the columns that it ``needs``, and returns the places of the rows to give, in any order and number, and a
    list for each field of ``more``; or yields such parts. The result has ``columns`` as in segments and those fields after them. Rows stream
    through Arrow batches sorted by document, so a document at a time has to fit in memory.
    """
    needs, columns = list(needs), list(columns)
    fields = [segments.schema[c] for c in columns]
    added = _parse_datatype_string(more).fields if more else []
    place = "place"
    while place in segments.columns:
        place += "_"
    used = list(dict.fromkeys([*columns, *needs]))
    rows = segments.withColumn(place, F.row_number().over(W.partitionBy(key).orderBy("index"))).select(*used, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(x.dataType) for x in added]
        for b, ends in _documents(batches, place):
            lists = [b.column(c).to_pylist() for c in needs]
            rows_of = b.select(columns)
            take: list[int] = []
            values: list[list] = [[] for _ in added]

            def made(rows_of=rows_of, take=take, values=values) -> pa.RecordBatch:
                kept = rows_of.take(pa.array(take, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, values, kinds)], [*columns, *(x.name for x in added)])

            for s, e in zip(ends.tolist(), ends[1:].tolist()):
                given = f(*(x[s:e] for x in lists))
                for places, *own in [given] if isinstance(given, tuple) else given:
                    take.extend(s + k for k in places)
                    for all_values, v in zip(values, own):
                        all_values.extend(v)
                    if len(take) >= PIECE_TAKEN:
                        yield made()
                        for x in (take, *values):
                            x.clear()
            yield made()

    return rows.mapInArrow(run, StructType([*fields, *added]))

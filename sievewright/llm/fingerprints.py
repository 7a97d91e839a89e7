"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame and SQL functions only.

A text is cut into pieces by one rule at every size: a piece ends, SHORTEST characters after its start at the earliest
and LONGEST at the latest, at a line end or at white space after a full stop or the like or one of two frequent letters,
so a changed tail leaves the digests before it alone and a changed head most of those after it. The 64-bit digests of the distinct pieces go into a sketch of three subtables, each digest
into one cell of each, and a cell holds a count, the xor of its digests and the xor of their check hashes.

The returned fingerprint of a text is such a sketch of fixed size. Those of two texts are subtracted cell by cell, which
cancels common digests, and peeling recovers those that differ: a cell whose check fits holds a single digest, which is
taken out of its other cells, until nothing is left. Where peeling gets stuck, larger sketches of the texts are subtracted:
these have a single table, the cell is a digest's leading bits, with so many cells for the square of what may differ that
digests hardly ever meet in one; empty cells are not held. If some do, all 64 bits are taken. The likeness of two
fingerprints is the share of common digests in all digests of the two (Jaccard), from the two counts and the number of
recovered ones; it is 1 for equal digest sets.

Rows are placed in ranges of doc_id by one shuffle of the texts, and their digests are a written table. All grouping is by
range and row, so one shuffle of the digests serves it; cells are plain grouped xor aggregates over exploded digests, and
only the cells of fingerprints become arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stage, setting

#: Code points of a piece, but for the last one of a text.
SHORTEST, LONGEST = 24, 120
#: Bits of a place in a subtable of a fingerprint; bits of a larger sketch's cell beyond those of the square of its digests.
PRINT_BITS, SPARE_BITS = 3, 12
CELLS = 3 << PRINT_BITS
#: Lets tables that are both placed by the range meet on range and row without another shuffle.
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def pieces_sql(text: str) -> str:
    """array<long>: the distinct digests of a text, sorted."""
    space = "[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]"
    piece = f"(?s).{{{SHORTEST},{LONGEST}}}?(?:(?<=[.!?;:nt]){space}+|\\\\n|\\\\z)|.{{1,{LONGEST}}}"
    return f"array_sort(array_distinct(transform(regexp_extract_all({text}, '{piece}', 0), x -> xxhash64(x))))"


def _places(d: str, bits: int) -> list[str]:
    return [f"cast({i << bits} + (shiftrightunsigned({d}, {i * bits}) & {(1 << bits) - 1}) as int)" for i in range(3)]


def _sides(rows: DataFrame, *digests: str) -> DataFrame:
    """(..., p, d): each row's digests of the arrays given, p is the array's place; a null for one without digests."""
    keys = [c for c in rows.columns if c not in ("a", "e", "x")]
    return rows.select(*keys, F.posexplode(F.array(*digests)).alias("p", "ds")).select(*keys, "p", F.explode_outer("ds").alias("d"))


def peel_sql(cells: str, bits: int = PRINT_BITS) -> str:
    """How many digests peeling recovers from the cells of a difference; null if it gets stuck."""
    keys = "array_distinct(transform(filter(st.cells, x -> xxhash64(x.k) = x.s), x -> x.k))"
    j0, j1, j2 = _places("d", bits)
    pure = f"transform({keys}, d -> named_struct('d', d, 'h', xxhash64(d), 'j0', {j0}, 'j1', {j1}, 'j2', {j2}))"
    less = "aggregate(filter(pure, p -> p.j0 = x.j or p.j1 = x.j or p.j2 = x.j), x, (a, p) -> named_struct('j', a.j, 'k', a.k ^ p.d, 's', a.s ^ p.h))"
    rest = f"filter(transform(st.cells, x -> {less}), x -> x.k != 0L or x.s != 0L)"
    step = f"transform(array({pure}), pure -> if(size(pure) = 0, named_struct('cells', st.cells, 'n', cast(null as int), 'go', false), transform(array({rest}), rest -> named_struct('cells', rest, 'n', st.n + size(pure), 'go', size(rest) > 0))[0]))[0]"
    start = f"named_struct('cells', transform({cells}, x -> named_struct('j', x.j, 'k', x.k, 's', x.s)), 'n', 0, 'go', true)"
    return f"aggregate(sequence(1, 24), {start}, (st, r) -> if(st.go, {step}, st), st -> if(st.go, cast(null as int), st.n))"


def _prints(rows: DataFrame) -> DataFrame:
    """(b, r, n0, n1, n2, print0, print1, d0, d1) of rows (b, r, guest, a, e): the numbers of digests of the text, the edited
    and the next one, the first two's fingerprints, and what peeling recovers of the text's less the other two's, null if stuck."""
    places = [F.expr(p).alias(f"j{i}") for i, p in enumerate(_places("d", PRINT_BITS))]
    e = _sides(rows.select("b", "r", "guest", "a", "e"), "a", "e").select("b", "r", "guest", "p", "d", F.xxhash64("d").alias("h"), *places)
    here = [F.col(f"j{j >> PRINT_BITS}") == j for j in range(CELLS)]
    cells = e.groupBy("b", "r", "guest", "p").agg(
        F.count("d").alias("n"),
        *(F.count_if(x).alias(f"c{j}") for j, x in enumerate(here)),
        *(F.bit_xor(F.when(x, F.col(v)).otherwise(F.lit(0))).alias(f"{k}{j}") for k, v in (("k", "d"), ("s", "h")) for j, x in enumerate(here)),
    )
    dense = cells.select("b", "r", "guest", "p", "n", *(F.array(*(f"{k}{j}" for j in range(CELLS))).alias(k) for k in "cks"))
    # each row's text and edited text follow one another, then the next row's text
    order = W.partitionBy("b").orderBy("r", "p")
    at = {x: [f"{x}0", f"{x}1", f"{x}2"] for x in "ncks"}
    near = dense.select("*", *(F.lead(x, k).over(order).alias(at[x][k]) for k in (1, 2) for x in "ncks"))
    near = near.where("p = 0 and guest = 0").withColumnsRenamed({x: at[x][0] for x in "ncks"})
    hexed = "transform(filter(sequence(0, {last}), j -> c{p}[j] > 0), j -> concat(lpad(hex(j), 2, '0'), lpad(hex(c{p}[j]), 8, '0'), lpad(hex(k{p}[j]), 16, '0'), lpad(hex(s{p}[j]), 16, '0')))"
    prints = [F.expr(f"unhex(array_join({hexed.format(p=p, last=CELLS - 1)}, ''))").alias(f"print{p}") for p in (0, 1)]
    return near.select("b", "r", *at["n"], *prints, *(F.expr(less_sql(p)).alias(f"d{p - 1}") for p in (1, 2)))


def less_sql(p: int) -> str:
    """How many digests peeling recovers from the cells of fingerprint 0 less those of p; null if it gets stuck, as it must with more digests than cells."""
    less = f"filter(transform(sequence(0, {CELLS - 1}), j -> named_struct('j', j, 'k', k0[j] ^ k{p}[j], 's', s0[j] ^ s{p}[j])), x -> x.k != 0L or x.s != 0L)"
    return f"if(abs(n0 - n{p}) > {CELLS}, null, transform(array({less}), x -> if(size(x) = 0, 0, {peel_sql('x')}))[0])"


def _larger(rows: DataFrame, whole: bool) -> DataFrame:
    """(b, r, x0, x1) of rows (b, r, a, e, x): how many digests the larger sketches of a and e, and of a and x, differ by; null
    if digests meet in a cell. whole: cells of all 64 bits."""
    bits = F.lit(64) if whole else F.least(F.lit(64), F.ceil(2 * F.log2(F.size("a") + F.size("e") + F.size("x") + F.lit(1))) + SPARE_BITS)
    e = _sides(rows.select("b", "r", bits.cast("int").alias("bits"), "a", "e", "x"), "a", "e", "x").where("d is not null")
    e = e.select("b", "r", "p", "d", F.xxhash64("d").alias("h"), F.expr("if(bits = 64, d, shiftrightunsigned(d, 64 - bits))").alias("g"))
    pair = lambda p, v: F.bit_xor(F.when(F.col("p").isin(0, p), F.col(v)).otherwise(F.lit(0)))
    cells = e.groupBy("b", "r", "g").agg(*(pair(p, v).alias(f"{k}{p}") for p in (1, 2) for k, v in (("k", "d"), ("s", "h"))))
    held = lambda p: (F.col(f"k{p}") != 0) | (F.col(f"s{p}") != 0)
    met = lambda p: held(p) & (F.xxhash64(f"k{p}") != F.col(f"s{p}"))
    return cells.groupBy("b", "r").agg(*(F.when(F.count_if(met(p)) == 0, F.count_if(held(p))).alias(f"x{p - 1}") for p in (1, 2)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, b, guest, next): of the rows with guest 0, next is the text of the following row by descending doc_id, of the last row the first's.

    Rows go to ranges of doc_id, two for each of ``parts`` partitions, cut at its quantiles, in one shuffle; the first row of each range is also
    sent to the range before it, so that a window over each range alone sees every row's successor. Equal doc_ids are
    ordered by text; null doc_ids come last.
    """
    spark = docs.sparkSession
    ranges = 2 * parts
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    stride = max(1, round(len(cuts) ** 0.5))
    coarse, x = cuts[stride - 1 :: stride], F.col("doc_id")
    # number of cuts at or above doc_id, by a search over every stride-th cut and then within one stride
    if cuts:
        step = F.size(F.filter(F.lit(coarse), lambda c: c >= x)) * stride if coarse else F.lit(0)
        bucket = step + F.size(F.filter(F.slice(F.lit(cuts), step + 1, F.lit(stride)), lambda c: c >= x))
        bucket = F.when(x.isNull(), len(cuts) + 1).otherwise(bucket)
    else:
        bucket = F.when(x.isNull(), 1).otherwise(0)
    placed = docs.withColumn("b", bucket.cast("int"))
    heads = {r["b"]: r["head"] for r in placed.groupBy("b").agg(F.max("doc_id").alias("head")).collect()}  # one row a range
    if not heads:
        return docs.select("doc_id", "text", F.lit(0).alias("b"), F.lit(0).alias("guest"), F.lit(None).cast("string").alias("next"))
    used = sorted(heads)
    ahead = spark.createDataFrame([(b, heads[b], used[i - 1]) for i, b in enumerate(used)], "b int, head long, guest_of int")
    held = placed.join(F.broadcast(ahead), "b")
    stays, visits = F.struct(F.col("b"), F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("b"), F.lit(1).alias("guest"))
    places = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(stays, visits)).otherwise(F.array(stays)))
    rows = held.select("doc_id", "text", places.alias("at")).select("doc_id", "text", F.col("at.b").alias("b"), F.col("at.guest").alias("guest"))
    return rows.repartition(parts, "b").withColumn("next", F.lead("text").over(_order()))


def _order() -> W:
    return W.partitionBy("b").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")


def _likeness(a: str, b: str, d: str) -> F.Column:
    return F.expr(f"if({a} + {b} = 0, 1D, cast({a} + {b} - {d} as double) / ({a} + {b} + {d}))")


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    edited: the last third of the code points replaced by as many from the start of the next text, or all of it.
    Null texts count as empty; two texts without pieces have likeness 1. Rows that share a doc_id follow one another in
    the order of their texts, null doc_ids come last. A single row is its own successor. An empty table gives an empty
    result. Columns other than doc_id and text are ignored. Equal texts have equal fingerprints.
    """
    stage = Stage(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # cells take many times the room of their text
    near = with_next(rows, parts).withColumn("r", F.row_number().over(_order()))
    third = "cast(floor(length(text) / 3) as int)"
    edited = F.concat(F.expr(f"left(text, length(text) - {third})"), F.expr(f"left(next, {third})"))
    near = near.withColumn("edited", F.when(F.col("guest") == 0, edited))  # of a guest only the text counts
    columns = [F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.expr(pieces_sql("text")).alias("a"), F.expr(pieces_sql("edited")).alias("e")]
    sides = stage.keep(near.select("b", "r", "guest", "doc_id", *columns), "sides")
    placed = sides.select("b", "r", "guest", "a", "e").repartition(parts, "b")
    done = stage.keep(_prints(placed), "prints")
    follow = W.partitionBy("b").orderBy("r")
    pairs = placed.withColumn("x", F.lead("a").over(follow)).where("guest = 0")
    for whole in (False, True):
        stuck = done.where("d0 is null or d1 is null").select("b", "r")
        if stuck.isEmpty():
            break
        with setting(spark, _CO_PARTITION, "false"):
            again = pairs.join(stuck.repartition(parts, "b").hint("merge"), ["b", "r"], "left_semi")
            larger = stage.keep(_larger(again, whole), f"larger{int(whole)}")
        done = done.join(larger, ["b", "r"], "left").withColumn("d0", F.coalesce("d0", "x0")).withColumn("d1", F.coalesce("d1", "x1")).drop("x0", "x1")
    out = sides.where("guest = 0").select("b", "r", "doc_id", "n_chars", "edited_sha256").join(done, ["b", "r"])
    text = lambda p: F.concat_ws("-", F.hex(f"n{p}"), F.coalesce(F.base64(f"print{p}"), F.lit("")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text(0).alias("fingerprint"),
        text(1).alias("edited_fingerprint"),
        _likeness("n0", "n1", "d0").alias("near_edited"),
        _likeness("n0", "n2", "d1").alias("near_next"),
    )

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import neardup, relevance, segments
from sievewright.plans.squeeze import squeeze

from . import restated as R

TOKENS = [("", 0), ("   \t  ", 0), ("cat", 1), ("a" * 40, 10), ("123456789", 3), ("42", 1), ("一二三", 3), ("\n\n\n", 2), ("!!!", 2), ("don't", 2), ("café", 2), ("hello     world", 3), (None, 0)]
ALPHABET = ["a", "bc", "'", "’", "1", "22", "\n", " ", "一", "é", "\x1c", "\x0b", " ", "😀", "!"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens(spark):
    got = docs(spark, [t for t, _ in TOKENS]).select("doc_id", T.estimate_tokens("text").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: n for i, (_, n) in enumerate(TOKENS)}


def test_tokens_and_truncation_at_random(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(400)] + ["'a" * 5000, "word " * 200]
    d = docs(spark, texts)
    got = d.select("doc_id", T.estimate_tokens("text").alias("n"), T.truncate_to_tokens("text", 6).alias("t"), T.truncate_to_tokens("text", 9, " [cut]").alias("s"), T.truncate_to_tokens("text", 0).alias("z")).collect()
    for r in got:
        x = texts[r.doc_id]
        assert (r.n, r.t, r.s, r.z) == (R.tokens(x), R.truncate(x, 6), R.truncate(x, 9, " [cut]"), "")


def test_segments(spark):
    rng = random.Random(2)
    pool = ["", " ", "para", "two words", "```", "```py", "~~~", " ~~~ x", " ```", "code\r", "\x1c"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(300)] + ["", "   \n\t  \n", "a\n\n```\nx\n\n\n"]
    got = {}
    for r in segments.split_segments(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == R.segments(t), t


def test_join_segments(spark):
    s = segments.split_segments(docs(spark, ["one\n\ntwo\n\nthree"]))
    assert segments.join_segments(s, separator=" | ").first().text == "one | two | three"
    assert segments.join_segments(s).first().text == "one\n\ntwo\n\nthree"


def test_shingles_and_jaccard(spark):
    d = docs(spark, ["", "one two three", "One  Two", "a b c d e f"])
    assert [r.n for r in d.orderBy("doc_id").select(F.size(T.shingles("text")).alias("n")).collect()] == [0, 1, 1, 2]
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    pairs = [(a(), a(), 1.0), (a("x"), a(), 0.0), (a("x"), a("x"), 1.0), (a("a", "b", "c"), a("b", "c", "d"), 0.5)]
    assert list(spark.range(1).select(*[T.jaccard(x, y).alias(str(k)) for k, (x, y, _) in enumerate(pairs)]).first()) == [p[2] for p in pairs]
    with pytest.raises(ValueError):
        T.shingles("text", 0)


@pytest.mark.parametrize("threshold,size", [(0.5, 1), (0.8, 2), (0.0, 5), (1.5, 5)])
def test_near_duplicates(spark, threshold, size):
    rng = random.Random(3)
    texts = ["\n\n".join(" ".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(8)) for _ in range(40)] + ["x y z w\n\n```\nx y z w\n```"]
    s = segments.split_segments(docs(spark, texts))
    got = {}
    for r in neardup.near_duplicates(s, threshold, size).collect():
        got.setdefault(r.doc_id, []).append(r["index"])
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == R.duplicates(R.segments(t), threshold, size)


def test_selection(spark):
    s = spark.createDataFrame([(1, i, "text", i, i, n, "x") for i, n in enumerate([5, 9, 3])], "doc_id long, index int, kind string, start_line int, end_line int, tokens int, text string")
    flat = spark.createDataFrame([(1, i, 0.0) for i in range(3)], "doc_id long, index int, score double")
    assert sorted(r["index"] for r in relevance.select_by_score(s, 8, flat).collect()) == [0, 2]
    assert sorted(r["index"] for r in relevance.head_tail(s, 16, 0.5).collect()) == [0, 2]


def test_squeeze(spark):
    p = "The quick brown fox jumps over the lazy dog near the river bank today"
    d = docs(spark, [f"{p}\n\n{p}\n\nshort", "", None, "\n\n\n"])
    got = {r.doc_id: r for r in squeeze(d, 100, "dedupe").collect()}
    assert got[0].text == f"{p}\n\n[1 segments elided]\n\nshort" and got[0].notes == ["dedupe dropped 1 near-duplicate segment(s)"]
    assert (got[0].segments_in, got[0].segments_out) == (3, 2)
    assert all(got[k].text == "" and got[k].segments_in == 0 for k in (1, 2, 3)) and got[3].original_tokens == 2
    assert all(R.tokens(r.text) == r.final_tokens <= 9 for r in squeeze(d, 9, "head-tail", marker=False).collect())
    with pytest.raises(ValueError, match="unknown strategy"):
        squeeze(d, 9, "nonsense")


def test_squeeze_keeps_null_keys_and_caches_nothing(spark):
    d = spark.createDataFrame([(None, "one\n\ntwo"), (None, "three"), (1, "four")], "doc_id long, text string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert sorted((r.doc_id is None, r.text) for r in squeeze(d, 50, "dedupe,score").collect()) == [(False, "four"), (True, "one\n\ntwo"), (True, "three")]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_squeeze_with_a_registered_stage(spark):
    from sievewright.plans import squeeze as S

    S.register_stage("first", lambda segments, **_: segments.where("index = 0"), "first dropped %d segment(s)")
    try:
        got = squeeze(docs(spark, ["one\n\ntwo", ""]), 50, "first").orderBy("doc_id").collect()
    finally:
        del S.STRATEGIES["first"], S._NOTES["first"]
    assert [(r.text, r.segments_out, r.notes) for r in got] == [("one\n\n[1 segments elided]", 1, ["first dropped 1 segment(s)"]), ("", 0, [])]


def test_functions_in_sql(spark):
    T.register(spark)
    row = spark.sql("select estimate_tokens('hello world'), truncate_to_tokens('one two three four', 2, ''), text_shingles('a b c', 2), fits_budget('cat', 1), jaccard(text_words('a b'), array('a'))").first()
    assert list(row) == [R.tokens("hello world"), R.truncate("one two three four", 2), ["a b", "b c"], True, 0.5]


def test_write_texts(spark, tmp_path):
    from sievewright.sources.files import write_texts

    write_texts(docs(spark, ["abc", "d\ne\n"]).coalesce(1), f"{tmp_path}/out")
    assert "".join(p.read_text() for p in sorted(tmp_path.glob("out/part*"))) == "abc\nd\ne\n"


def test_batches_of_documents():
    from sievewright.operators import batches

    lengths = [1, 3, 2500, 2, 1, 1, 4000, 5]
    place = [k for n in lengths for k in range(1, n + 1)]
    for step in (1, 2, 7, 1000, 2600, 9999):
        given = [pa.RecordBatch.from_pydict({"place": place[i : i + step], "at": [*range(i, min(i + step, len(place)))]}) for i in range(0, len(place), step)]
        seen, sizes = [], []
        for b, ends in batches._documents(given, "place"):
            seen += b.column("at").to_pylist()
            sizes += [e - s for s, e in zip(ends, ends[1:])]
            assert b.num_rows <= batches.PIECE_ROWS or len(ends) == 2
        assert seen == [*range(len(place))] and sizes == lengths


def test_by_document_with_parts_and_null_keys(spark):
    from sievewright.operators.batches import by_document

    rows = [(k, i, f"{k}-{i}") for k in (None, 1, 2) for i in (2, 0, 1)]
    s = spark.createDataFrame(rows, "place long, index int, text string")
    f = lambda index, texts: (([k, k], [x, x], [len(texts)] * 2) for k, x in zip(index, texts))
    got = by_document(s, "place", ("index", "text"), f, ("place", "index"), "t string, n long").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, i, t, 3)) for k, i, t in rows for _ in range(2))


def test_texts_are_cut_piece_by_piece(spark, monkeypatch):
    from sievewright.functions import reading
    from sievewright.operators import batches

    texts = [None, "", "one\n\ntwo", *(f"é {i} word{' many' * 200}\n\n" * 500 for i in range(8)), ("x" * 999 + "\n\n") * 1200, None, "end"]
    some = pa.RecordBatch.from_pydict({"doc_id": [*range(len(texts))], "text": texts})
    assert pa.Table.from_batches(batches.pieces([some.slice(1), some.slice(0, 0)])) == pa.Table.from_batches([some.slice(1)])
    cut, most = reading.segments_of, []
    monkeypatch.setattr(reading, "segments_of", lambda texts: most.append(sum(len(t.encode()) for t in texts if len(t) < 1 << 20)) or cut(texts))
    listed = segments._listed(some.column("text"))
    assert listed.to_pylist() == [[x._asdict() for x in f] for f in cut([t or "" for t in texts])]
    assert max(most) <= batches.PIECE_BYTES and len(most) > 4
    # an explode of a function's array was answered by calling it twice
    counted = segments.split_segments(docs(spark, texts)).groupBy("doc_id").count()
    assert "Python" not in _plan(counted) and _plan(counted).count("MapInArrow") == 1
    assert sorted(map(tuple, counted.collect())) == [(i, len(f)) for i, f in enumerate(listed.to_pylist()) if f]


def test_squeeze_works_piece_by_piece(monkeypatch):
    from sievewright.functions import reading
    from sievewright.operators import batches
    from sievewright.plans import squeeze as S

    texts = [f"{i} word{' many' * 200}\n\n" * 60 for i in range(60)] + ["", "one\n\ntwo"]
    some = pa.RecordBatch.from_pydict({"doc_id": [*range(len(texts))], "text": texts})
    cut, most = reading.segments_of, []
    monkeypatch.setattr(reading, "segments_of", lambda texts: most.append(sum(map(len, texts))) or cut(texts))
    run = S._squeezed(["score"], True, "doc_id", {"budget": 600, "head_ratio": 0.5, "jaccard": 0.8, "shingle_size": 5})
    many = pa.Table.from_batches(run(iter([some])))
    assert max(most) <= batches.PIECE_BYTES and len(most) > 3
    assert many.to_pylist() == [r for k in range(len(texts)) for b in run(iter([some.slice(k, 1)])) for r in b.to_pylist()]


def test_arrays_of_estimates_are_bounded(monkeypatch):
    from sievewright.functions import reading

    costs, most = reading.run_costs, []
    monkeypatch.setattr(reading, "run_costs", lambda texts: most.append(sum(map(len, texts))) or costs(texts))
    texts = ["word 1 " * n for n in (0, 20_000, 1, 30_000, 5, 0, 60_000, 2)]
    got = reading.tokens_of(texts)
    assert max(most) <= 420_000 and len(most) > 2
    monkeypatch.undo()
    assert got == [reading.tokens(t) for t in texts]


def test_words_shingles_and_one_intersection(spark):
    spaces = [chr(c) for c in [*range(9, 14), *range(28, 33), 0x85]]
    words = docs(spark, ["".join(f"{chr(c)}A{spaces[c % len(spaces)]}" for c in [*range(33, 127), 0xE9, 0x4E00, 0x1F600])]).select(T.words("text").alias("w"))
    assert words.first().w == [f"{chr(c)}A".lower() for c in [*range(33, 127), 0xE9, 0x4E00, 0x1F600]]
    # characters that aren't white space are told by one range, and likeness takes one intersection
    pair = docs(spark, ["a b"]).select(T.jaccard(T.words("text"), T.words("text")).alias("j"))
    assert pair._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1 and "[!-~" in _plan(words)
    odd = docs(spark, [None, "", "a", "a a", "a b c", "A b a b"])
    for size, want in ((1, [None, [], ["a"], ["a"], ["a", "b", "c"], ["a", "b"]]), (2, [None, [], ["a"], ["a a"], ["a b", "b c"], ["a b", "b a"]])):
        assert [r.s for r in odd.orderBy("doc_id").select(T.shingles("text", size).alias("s")).collect()] == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold,size", [(0.8, 5), (0.3, 1), (0.5, 2)])
def test_similar_pairs(spark, threshold, size):
    rng = random.Random(7)
    texts = ["\n\n".join(" ".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(12)) for _ in range(30)] + ["", "x y z w\n\n```\nx y z w\n```", "a b\n\n" * 40]
    d = docs(spark, texts).unionByName(spark.createDataFrame([(None, "a b\n\na b")], "doc_id long, text string"))
    s = segments.split_segments(d)
    found = neardup.similar_pairs(s, threshold, size)
    # no join of shingles, which took one side for small and sent it to the driver; one shuffle
    assert "Join" not in _plan(found) and _plan(found).count("Exchange hashpartitioning") == 1
    got = sorted(map(tuple, found.collect()))
    want = []
    for n, t in enumerate(texts):
        sets = [(kind, set(R.shingles(x, size)) or {""}) for _, kind, _, _, _, x in R.segments(t)]
        want += [(n, k, i, j, len(a & b) / len(a | b)) for i, (k, a) in enumerate(sets) for j, (kind, b) in enumerate(sets) if i < j and k == kind and a & b and len(a & b) / len(a | b) >= threshold]
    assert got == sorted(want)

"""The registered queries over documents and conversations, and the same in SQL for an independent check.

No document has a blank line or a fence and no conversation has tool ids, so the queries derive them from every row:
each newline becomes two, a copy is wrapped in fences, and every third message issues an id that a later one answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import STOPWORDS
from ..operators import neardup, relevance, segments
from . import transcript
from .squeeze import squeeze

BUDGET = 200
Query = Callable[[SparkSession, str], DataFrame]


# --- inputs --------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def _fenced(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("intro\n```py\n"), "text", F.lit("\n~~~\n\n```\nafter\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n ~~~\ntail\n\nend"))
    return _documents(spark, d).select("doc_id", fenced.alias("text"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.split_segments(_paragraphs(spark, d))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return transcript.messages_from_table(spark.read.parquet(f"{d}/conversations.parquet"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    none, at = F.array().cast("array<string>"), F.col("index")
    name = lambda i: F.array(F.concat_ws(":", "conv_id", i))
    calls = F.when((at % 3 == 1) & (F.col("role") == "assistant"), name(at)).otherwise(none)
    results = F.when((at >= 4) & (at % 3 == 1), name(at - 3)).when((at >= 3) & (at % 3 == 0), name(at - 2)).otherwise(none)
    return _messages(spark, d).withColumn("tool_call_ids", calls).withColumn("tool_result_ids", results)


# --- queries -------------------------------------------------------------------------------------------------------


def token_class_counts(spark: SparkSession, d: str) -> DataFrame:
    run = _documents(spark, d).select("doc_id", F.explode(T.runs("text")).alias("r"))
    first = F.ascii("r")
    kind = F.when(first.between(97, 122) | first.between(65, 90), "word").when(first == 10, "newline").when(first.between(48, 57), "number").otherwise("other")
    return run.groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.length("r")).alias("n_chars"))


def tokens_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).withColumn("t", T.estimate_tokens("text")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("tokens"))


def shingle_sets(spark: SparkSession, d: str) -> DataFrame:
    s = _documents(spark, d).select("doc_id", F.array_sort(T.shingles("text", 5)).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_shingles"), F.md5(F.array_join("s", "|")).alias("digest"))


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = _documents(spark, d).select("doc_id", T.shingles("text", 1).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.jaccard("a", "b"), 9).alias("jaccard"))


def _squeezed(strategy: str, budget: int = BUDGET, **options: object) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = squeeze(_paragraphs(spark, d), budget, strategy, **options)
        return out.withColumn("notes", F.array_join("notes", "; "))

    return run


def prune_summary(spark: SparkSession, d: str) -> DataFrame:
    out = transcript.prune_summary(_linked(spark, d), 300, 1)
    return out.withColumn("pinned_tool_results", F.array_join("pinned_tool_results", ",")).withColumn("notes", F.array_join("notes", "; "))


def pinned(spark: SparkSession, d: str) -> DataFrame:
    marked = transcript.mark_kept(_linked(spark, d), 300, 1)
    return transcript.pinned_tool_results(marked).withColumn("pinned", F.array_join("pinned", ","))


def parse_messages(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.messages import parse_messages as parse

    m = _linked(spark, d)
    call = F.struct(F.concat_ws(":", "conv_id", "index").alias("id"), F.struct(F.lit("look_up").alias("name"), F.col("text").alias("arguments")).alias("function"))
    raw = F.to_json(F.struct("role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", F.array(call)).alias("tool_calls"), F.when(F.col("role") == "user", F.concat_ws(":", "conv_id", F.col("index") - 1)).alias("tool_call_id")))
    out = parse(m.select("conv_id", "index", raw.alias("raw")))
    return out.select("conv_id", "index", "role", "text", "tokens", F.array_join("tool_call_ids", ",").alias("call_ids"), F.array_join("tool_result_ids", ",").alias("result_ids"))


QUERIES: dict[str, Query] = {
    "token_estimate": lambda s, d: _documents(s, d).select("doc_id", T.estimate_tokens("text").alias("tokens")),
    "tokens_by_lang": tokens_by_lang,
    "fits_budget": lambda s, d: _documents(s, d).select("doc_id", T.fits_budget("text", 500).alias("fits")),
    "token_class_counts": token_class_counts,
    "truncate_tokens": lambda s, d: _documents(s, d).select("doc_id", T.truncate_to_tokens("text", BUDGET).alias("text")),
    "truncate_tokens_suffix": lambda s, d: _documents(s, d).select("doc_id", T.truncate_to_tokens("text", BUDGET, " [cut]").alias("text")),
    "split_paragraphs": lambda s, d: _segments(s, d),
    "split_fenced": lambda s, d: segments.split_segments(_fenced(s, d)),
    "join_segments": lambda s, d: segments.join_segments(_segments(s, d), separator=" | "),
    "shingles": shingle_sets,
    "jaccard_pairs": jaccard_pairs,
    "similar_pairs": lambda s, d: neardup.similar_pairs(_segments(s, d)).withColumn("jaccard", F.round("jaccard", 9)),
    "near_duplicates": lambda s, d: neardup.near_duplicates(_segments(s, d)),
    "dedupe_segments": lambda s, d: neardup.dedupe_segments(_segments(s, d), 0.5, 2).select("doc_id", "index", "tokens"),
    "term_freq": lambda s, d: relevance.term_frequency(_segments(s, d)),
    "doc_freq": lambda s, d: relevance.document_frequency(_segments(s, d)),
    "tfidf_scores": lambda s, d: relevance.score_segments(_segments(s, d)),
    "select_by_score": lambda s, d: relevance.select_by_score(_segments(s, d), BUDGET).select("doc_id", "index", "tokens"),
    "head_tail": lambda s, d: relevance.head_tail(_segments(s, d), 205, 0.3).select("doc_id", "index", "tokens"),
    "squeeze_score": _squeezed("score"),
    "squeeze_head_tail": _squeezed("head-tail", head_ratio=0.3),
    "squeeze_dedupe_score": _squeezed("dedupe,score"),
    "squeeze_no_marker": _squeezed("dedupe,head-tail", marker=False),
    "squeeze_tight_budget": _squeezed("score", 12),
    "squeeze_no_stage": _squeezed("", 400),
    "conversation_turns": lambda s, d: transcript.group_turns(_messages(s, d)).select("conv_id", "index", "role", "turn_id", "tokens"),
    "recent_window": lambda s, d: transcript.recent_window(_messages(s, d), 2).where("recent").select("conv_id", "index"),
    "tool_groups": lambda s, d: transcript.tool_groups(_linked(s, d)),
    "prune_conversations": lambda s, d: transcript.prune_messages(_linked(s, d), 300, 1),
    "prune_summary": prune_summary,
    "pinned_tool_results": pinned,
    "parse_messages": parse_messages,
}


# --- the same in DuckDB SQL ----------------------------------------------------------------------------------------

_NL = "chr(10)"
_CLASSES = r"\n+|[A-Za-z]+(?:[''’][A-Za-z]+)*|[0-9]+|[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]+|[^ \t\r\f\v]"
_RUN_COST = (
    "case when regexp_matches(r, '^[A-Za-z]') then greatest(1.0::double, length(r)::double / 4) when r[1] = chr(10) then length(r)::double * 0.5::double "
    r"when regexp_matches(r, '^[0-9]') then greatest(1.0::double, length(r)::double / 3) when regexp_matches(r, '^[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]') "
    "then length(r)::double else 0.6::double end"
)


def _est(x: str) -> str:
    return f"cast(ceil(list_reduce(list_transform(regexp_extract_all({x}, '{_CLASSES}'), lambda r: {_RUN_COST}), lambda a, b: a + b, 0.0::double)) as int)"


_D2 = f"replace(text, {_NL}, {_NL} || {_NL})"
_FENCED = f"'intro' || {_NL} || '```py' || {_NL} || text || {_NL} || '~~~' || {_NL} || {_NL} || '```' || {_NL} || 'after' || {_NL} || {_NL} || {_D2} || {_NL} || ' ~~~' || {_NL} || 'tail' || {_NL} || {_NL} || 'end'"
_LINES = "lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from src)"
_SEGS = f"""src as (select doc_id, {_D2} as t from documents), {_LINES},
runs as (select *, trim(line) = '' as blank, sum(case when trim(line) = '' then 1 else 0 end) over (partition by doc_id order by i) as run from lines),
bodies as (select doc_id, min(i) as a, max(i) as b, string_agg(line, chr(10) order by i) as text from runs where not blank group by doc_id, run),
segs as (select doc_id, cast(row_number() over (partition by doc_id order by a) - 1 as int) as index, 'text' as kind, cast(a as int) as start_line, cast(b as int) as end_line, {_est('text')} as tokens, text from bodies)"""
_SPLIT_FENCED = f"""with recursive src as (select doc_id, {_FENCED} as t from documents), {_LINES},
marked as (select *, case when trim(line) like '```%' then '```' when trim(line) like '~~~%' then '~~~' else '' end as m from lines),
auto(doc_id, i, before, after) as (select doc_id, i, '', m from marked where i = 1
  union all select m.doc_id, m.i, a.after, case when a.after = '' then m.m when a.after = m.m then '' else a.after end from auto a join marked m on m.doc_id = a.doc_id and m.i = a.i + 1),
kinds as (select m.doc_id, m.i, m.line, (a.before <> '' or a.after <> '') as code, a.before, trim(m.line) = '' as blank from marked m join auto a on a.doc_id = m.doc_id and a.i = m.i),
steps as (select *, case when code then before = '' else not blank and coalesce(lag(code or blank) over (partition by doc_id order by i), true) end as opens from kinds),
numbered as (select *, sum(opens::int) over (partition by doc_id order by i) as seg from steps where code or not blank),
bodies as (select doc_id, case when bool_or(code) then 'code' else 'text' end as kind, min(i) as a, max(i) as b, trim(string_agg(line, chr(10) order by i), chr(10)) as text from numbered group by doc_id, seg)
select doc_id, cast(row_number() over (partition by doc_id order by a) - 1 as int) as index, kind, cast(a as int) as start_line, cast(b as int) as end_line, {_est('text')} as tokens, text from bodies"""


def _shingle_list(size: int) -> str:
    """The distinct shingles of a list of words w."""
    return f"case when len(w) = 0 then []::varchar[] when len(w) <= {size} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) end"


_WORDS = r"regexp_extract_all(lower(text), '\S+') as w"


def _cut(source: str, budget: int, suffix: str = "") -> str:
    """CTEs cut(doc_id, text): what truncation makes of (doc_id, text) rows of ``source`` that don't fit."""
    room = f"({budget} - {_est(repr(suffix) if suffix else repr(''))})"
    return f"""halving(doc_id, text, lo, hi) as (select doc_id, text, 0, length(text) from {source} where {_est('text')} > {budget}
  union all select doc_id, text, case when {_est('text[1:(lo + hi + 1) // 2]')} <= {room} then (lo + hi + 1) // 2 else lo end,
  case when {_est('text[1:(lo + hi + 1) // 2]')} <= {room} then hi else (lo + hi + 1) // 2 - 1 end from halving where lo < hi),
cut as (select doc_id, rtrim(text[1:lo], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '{suffix}' as text from halving where lo >= hi)"""


def _truncated(suffix: str = "") -> str:
    return f"with recursive {_cut('documents', BUDGET, suffix)} select d.doc_id, coalesce(c.text, d.text) as text from documents d left join cut c on c.doc_id = d.doc_id"


def _pairs(source: str, threshold: float, size: int) -> str:
    return f"""worded as materialized (select doc_id, kind, index, {_WORDS} from {source}),
sets as materialized (select doc_id, kind, index, {_shingle_list(size)} as s from worded),
shingled as (select doc_id, kind, index, len(s) as n, unnest(s) as w from sets),
pairs as (select a.doc_id, a.kind, a.index as i, b.index as j, count(*)::double / (a.n + b.n - count(*)) as jaccard from shingled a join shingled b
  on a.doc_id = b.doc_id and a.kind = b.kind and a.w = b.w and a.index < b.index group by all having a.n >= 0 and count(*)::double / (min(a.n) + min(b.n) - count(*)) >= {threshold}::double)""".replace("group by all", "group by a.doc_id, a.kind, a.index, b.index, a.n, b.n")


def _drops(source: str, threshold: float = 0.8, size: int = 5) -> str:
    return f"""{_pairs(source, threshold, size)},
nodes as (select doc_id, j, list(i order by i) as near from pairs group by doc_id, j),
folded as (select doc_id, list_reduce(list({{'j': j, 'near': near, 'gone': []::int[]}} order by j), lambda a, x: {{'j': x.j, 'near': x.near,
  'gone': case when len(list_filter(x.near, lambda i: not list_contains(a.gone, i))) > 0 then list_append(a.gone, x.j) else a.gone end}}, {{'j': -1, 'near': []::int[], 'gone': []::int[]}}) as f from nodes group by doc_id),
drops as (select doc_id, unnest(f.gone) as index from folded)"""


def _tf(source: str) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
    return f"""tokens_of as (select doc_id, index, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*')) as w from {source}),
tf as (select doc_id, index, lower(w) as word, count(*) as tf from tokens_of where length(w) > 2 and lower(w) not in ({stop}) group by all),
df as (select doc_id, word, count(*) as df from tf group by all),
sizes as (select doc_id, count(*) as n from {source} group by all),
means as (select tf.doc_id, tf.index, sum(tf * (ln((n + 1)::double / (df + 1)) + 1)) / sum(tf) as mean from tf join df on tf.doc_id = df.doc_id and tf.word = df.word join sizes on sizes.doc_id = tf.doc_id group by all),
scores as (select s.doc_id, s.index, s.tokens, round(coalesce(mean, 0), 9) as score from {source} s left join means m on m.doc_id = s.doc_id and m.index = s.index)"""


def _best(source: str, budget: int) -> str:
    return f"""{_tf(source)},
taken as (select doc_id, list_reduce(list({{'place': index, 'cost': tokens, 'room': 0, 'kept': []::int[]}} order by score desc, index), lambda a, x: case when x.cost <= a.room
  then {{'place': x.place, 'cost': x.cost, 'room': a.room - x.cost, 'kept': list_append(a.kept, x.place)}} else a end, {{'place': -1, 'cost': 0, 'room': {budget}, 'kept': []::int[]}}) as f from scores group by doc_id),
best as (select doc_id, unnest(f.kept) as index from taken)"""


def _ends(source: str, budget: int, ratio: float) -> str:
    head = round(budget * ratio)
    return f"""sums as (select doc_id, index, sum(tokens) over (partition by doc_id order by index) as up, sum(tokens) over (partition by doc_id order by index desc) as down from {source}),
ends as (select doc_id, index from sums where up <= {head} or down <= {max(budget - head, 0)})"""


def _squeeze_sql(strategy: list[str], budget: int = BUDGET, marker: bool = True, ratio: float = 0.5) -> str:
    ctes, now, notes = [_SEGS], "segs", []
    for k, name in enumerate(strategy):
        nxt = f"left{k}"
        if name == "dedupe":
            ctes.append(_drops(now))
            ctes.append(f"{nxt} as (select s.* from {now} s left join drops d on d.doc_id = s.doc_id and d.index = s.index where d.index is null)")
            note = "'dedupe dropped ' || n || ' near-duplicate segment(s)'"
        else:
            ctes.append(_best(now, budget) if name == "score" else _ends(now, budget, ratio))
            ctes.append(f"{nxt} as (select s.* from {now} s join {'best' if name == 'score' else 'ends'} k on k.doc_id = s.doc_id and k.index = s.index)")
            note = f"'{name} dropped ' || n || ' segment(s) outside the budget'"
        notes.append(note.replace("|| n ||", f"|| ((select count(*) from {now} x where x.doc_id = w.doc_id) - (select count(*) from {nxt} x where x.doc_id = w.doc_id)) ||"))
        notes[-1] = f"case when (select count(*) from {now} x where x.doc_id = w.doc_id) > (select count(*) from {nxt} x where x.doc_id = w.doc_id) then {notes[-1]} end"
        now = nxt
    ctes.append(f"flagged as (select s.doc_id, s.index, s.text, k.index is not null as kept from segs s left join {now} k on k.doc_id = s.doc_id and k.index = s.index)")
    ctes.append("islands as (select *, sum(kept::int) over (partition by doc_id order by index) as run from flagged)")
    gone = "select doc_id, min(index) as at, '[' || count(*) || ' segments elided]' as part from islands where not kept group by doc_id, run"
    ctes.append("parts as (select doc_id, index as at, text as part from islands where kept" + (f" union all {gone}" if marker else "") + ")")
    ctes.append(f"whole as (select d.doc_id, coalesce(string_agg(p.part, {_NL} || {_NL} order by p.at), '') as text from documents d left join parts p on p.doc_id = d.doc_id group by d.doc_id)")
    ctes.append(_cut("whole", budget))
    notes.append("case when c.doc_id is not null then 'hard-truncated output to stay within budget' end")
    return f"""with recursive {', '.join(ctes)} select w.doc_id, coalesce(c.text, w.text) as text, {_est(_D2.replace('text', 'd.text'))} as original_tokens, {_est('coalesce(c.text, w.text)')} as final_tokens,
cast((select count(*) from segs x where x.doc_id = w.doc_id) as int) as segments_in, cast((select count(*) from {now} x where x.doc_id = w.doc_id) as int) as segments_out, concat_ws('; ', {', '.join(notes)}) as notes
from whole w join documents d on d.doc_id = w.doc_id left join cut c on c.doc_id = w.doc_id"""


_MSGS = f"""msgs as (select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as index, role, text, {_est('text')} as tokens from conversations),
turned as (select *, case when role <> 'system' then cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by index) as int) end as turn_id from msgs)"""
_IDS = """ids as (select conv_id, index, conv_id || ':' || index as id from msgs where index % 3 = 1 and role = 'assistant'
  union select conv_id, index, conv_id || ':' || (index - 3) from msgs where index >= 4 and index % 3 = 1 union select conv_id, index, conv_id || ':' || (index - 2) from msgs where index >= 3 and index % 3 = 0)"""
_GROUPS = f"""{_IDS}, links as (select distinct a.conv_id, a.index as x, b.index as y from ids a join ids b on a.conv_id = b.conv_id and a.id = b.id),
reach(conv_id, x, y) as (select conv_id, index, index from msgs union select r.conv_id, r.x, l.y from reach r join links l on l.conv_id = r.conv_id and l.x = r.y),
groups as (select conv_id, x as index, min(y) as group_id from reach group by all)"""
_MARKED = f"""{_MSGS}, {_GROUPS},
guarded as (select t.*, g.group_id, coalesce(turn_id > max(turn_id) over (partition by t.conv_id) - 1, false) or role = 'system' as safe from turned t join groups g on g.conv_id = t.conv_id and g.index = t.index),
must as (select *, bool_or(safe) over (partition by conv_id, group_id) as mandatory from guarded),
rooms as (select conv_id, 300 - coalesce(sum(tokens) filter (where mandatory), 0) as room from must group by all),
items as (select conv_id, group_id, max(index) as last, sum(tokens) as cost from must where not mandatory group by all),
fills as (select i.conv_id, list_reduce(list({{'place': group_id, 'cost': cost::bigint, 'room': 0::bigint, 'kept': []::int[]}} order by last desc), lambda a, x: case when x.cost <= a.room
  then {{'place': x.place, 'cost': x.cost, 'room': a.room - x.cost, 'kept': list_append(a.kept, x.place)}} else a end, {{'place': -1, 'cost': 0::bigint, 'room': any_value(room)::bigint, 'kept': []::int[]}}) as f
  from items i join rooms r on r.conv_id = i.conv_id group by i.conv_id),
filled as (select conv_id, unnest(f.kept) as group_id from fills),
marked as (select m.*, m.mandatory or f.group_id is not null as kept from must m left join filled f on f.conv_id = m.conv_id and f.group_id = m.group_id),
islands as (select *, sum(kept::int) over (partition by conv_id order by index) as run from marked),
notes as (select conv_id, min(index) as pos, '[' || count(*) || ' earlier messages elided]' as text from islands where not kept group by conv_id, run),
sent as (select conv_id, index as pos, index, role, text, tokens from marked where kept union all select conv_id, pos, -1, 'system', text, {_est('text')} from notes),
pins as (select distinct m.conv_id, i.id from marked m join ids i on i.conv_id = m.conv_id and i.index = m.index where m.kept and not m.safe),
pinned as (select conv_id, string_agg(id, ',' order by id) as pinned, count(*) as n from pins group by all)"""

ORACLES: dict[str, str] = {
    "token_estimate": f"select doc_id, {_est('text')} as tokens from documents",
    "tokens_by_lang": f"select lang, count(*) as n_docs, cast(sum({_est('text')}) as bigint) as tokens from documents group by lang",
    "fits_budget": f"select doc_id, {_est('text')} <= 500 as fits from documents",
    "token_class_counts": f"""with runs as (select doc_id, unnest(regexp_extract_all(text, '{_CLASSES}')) as r from documents)
select doc_id, case when regexp_matches(r, '^[A-Za-z]') then 'word' when r[1] = chr(10) then 'newline' when regexp_matches(r, '^[0-9]') then 'number' else 'other' end as kind,
count(*) as n_runs, cast(sum(length(r)) as bigint) as n_chars from runs group by all""",
    "truncate_tokens": _truncated(),
    "truncate_tokens_suffix": _truncated(" [cut]"),
    "split_paragraphs": f"with {_SEGS} select * from segs",
    "split_fenced": _SPLIT_FENCED,
    "join_segments": f"with {_SEGS} select doc_id, string_agg(text, ' | ' order by index) as text from segs group by doc_id",
    "shingles": f"with v as materialized (select doc_id, {_WORDS} from documents), s as materialized (select doc_id, list_sort({_shingle_list(5)}) as s from v) select doc_id, cast(len(s) as int) as n_shingles, md5(array_to_string(s, '|')) as digest from s",
    "jaccard_pairs": f"""with v as materialized (select doc_id, {_WORDS} from documents), s as materialized (select doc_id, {_shingle_list(1)} as s from v)
select a.doc_id, round(len(list_intersect(a.s, b.s))::double / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 9) as jaccard from s a join s b on b.doc_id = a.doc_id + 1""",
    "similar_pairs": f"with {_SEGS}, {_pairs('segs', 0.8, 5)} select doc_id, kind, i, j, round(jaccard, 9) as jaccard from pairs",
    "near_duplicates": f"with {_SEGS}, {_drops('segs')} select * from drops",
    "dedupe_segments": f"with {_SEGS}, {_drops('segs', 0.5, 2)} select s.doc_id, s.index, s.tokens from segs s left join drops d on d.doc_id = s.doc_id and d.index = s.index where d.index is null",
    "term_freq": f"with {_SEGS}, {_tf('segs')} select doc_id, index, word, tf from tf",
    "doc_freq": f"with {_SEGS}, {_tf('segs')} select doc_id, word, df from df",
    "tfidf_scores": f"with {_SEGS}, {_tf('segs')} select doc_id, index, score from scores",
    "select_by_score": f"with {_SEGS}, {_best('segs', BUDGET)} select s.doc_id, s.index, s.tokens from segs s join best b on b.doc_id = s.doc_id and b.index = s.index",
    "head_tail": f"with {_SEGS}, {_ends('segs', 205, 0.3)} select s.doc_id, s.index, s.tokens from segs s join ends e on e.doc_id = s.doc_id and e.index = s.index",
    "squeeze_score": _squeeze_sql(["score"]),
    "squeeze_head_tail": _squeeze_sql(["head-tail"], ratio=0.3),
    "squeeze_dedupe_score": _squeeze_sql(["dedupe", "score"]),
    "squeeze_no_marker": _squeeze_sql(["dedupe", "head-tail"], marker=False),
    "squeeze_tight_budget": _squeeze_sql(["score"], 12),
    "squeeze_no_stage": _squeeze_sql([], 400),
    "conversation_turns": f"with {_MSGS} select conv_id, index, role, turn_id, tokens from turned",
    "recent_window": f"with {_MSGS}, w as (select *, max(turn_id) over (partition by conv_id) as last from turned) select conv_id, index from w where turn_id > last - 2",
    "tool_groups": f"with recursive {_MSGS}, {_GROUPS} select * from groups",
    "prune_conversations": f"with recursive {_MARKED} select conv_id, cast(row_number() over (partition by conv_id order by pos) - 1 as int) as position, index, role, text, tokens from sent",
    "prune_summary": f"""with recursive {_MARKED}, ins as (select conv_id, cast(sum(tokens) as int) as original_tokens, cast(count(*) as int) as messages_in,
count(*) filter (where kept and not mandatory) as added, count(*) filter (where not kept) as dropped from marked group by all),
outs as (select conv_id, cast(sum(tokens) as int) as final_tokens, cast(count(*) as int) as messages_out from sent group by all)
select ins.conv_id, original_tokens, coalesce(final_tokens, 0) as final_tokens, messages_in, coalesce(messages_out, 0) as messages_out, coalesce(pinned, '') as pinned_tool_results,
concat_ws('; ', case when added > 0 then 'kept ' || added || ' older message(s) outside the recent window' end, case when n > 0 then 'pinned ' || n || ' tool result(s) linked across the recent window' end,
case when dropped > 0 then 'dropped ' || dropped || ' message(s) outside the kept window' end) as notes
from ins left join outs on outs.conv_id = ins.conv_id left join pinned on pinned.conv_id = ins.conv_id""",
    "pinned_tool_results": f"with recursive {_MARKED} select conv_id, pinned from pinned",
    "parse_messages": f"""with {_MSGS}, flat as (select conv_id, index, role, case when role = 'assistant' then text || chr(10) || 'look_up(' || text || ')' else text end as text from msgs)
select conv_id, index, role, text, {_est('text')} as tokens, case when role = 'assistant' then conv_id || ':' || index else '' end as call_ids, case when role = 'user' then conv_id || ':' || (index - 1) else '' end as result_ids from flat""",
}

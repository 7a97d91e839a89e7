"""Chat messages from JSON, in either of two shapes: tool_calls beside the content, or content as a list of blocks.

Flattening writes tool arguments as JSON text whose exact form counts towards the token estimate and may nest without
bound, so this one step is an Arrow UDF; everything after it stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

_PARSED = "role string, text string, tool_call_ids array<string>, tool_result_ids array<string>"


def _joined(parts: list) -> str:
    return "\n".join(str(p) for p in parts if p)


def content_text(content: object) -> str:
    """The readable text of a content field; blocks of other kinds than text and tool_result have none."""
    if isinstance(content, str):
        return content
    blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
    readers = {"text": lambda b: b.get("text", ""), "tool_result": lambda b: content_text(b.get("content"))}
    return _joined([readers[b.get("type")](b) for b in blocks if b.get("type") in readers])


def _call(name: object, arguments: object) -> str:
    return f"{name}({arguments if isinstance(arguments, str) else json.dumps(arguments)})"


def parse_message(raw: dict) -> tuple[str | None, str, list[str], list[str]]:
    """(role, text, ids of tool calls, ids of tool results) of one message."""
    content = raw.get("content")
    blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
    asked = [c for c in raw.get("tool_calls") or () if isinstance(c, dict)]
    used = [b for b in blocks if b.get("type") == "tool_use"]
    functions = [c.get("function") or {} for c in asked]
    parts = [content_text(content), *(_call(f.get("name", ""), f.get("arguments", "")) for f in functions), *(_call(b.get("name", ""), b.get("input", "")) for b in used)]
    calls = [x["id"] for x in (*asked, *used) if x.get("id")]
    results = [raw["tool_call_id"]] if raw.get("tool_call_id") else []
    results += [b["tool_use_id"] for b in blocks if b.get("type") == "tool_result" and b.get("tool_use_id")]
    return raw.get("role", "user"), _joined(parts), [str(i) for i in calls], [str(i) for i in results]


def _parse(raws: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for raw in raws:
        yield pd.DataFrame([parse_message(json.loads(r)) for r in raw], columns=["role", "text", "tool_call_ids", "tool_result_ids"])


def parse_messages(rows: DataFrame) -> DataFrame:
    """Messages from rows (conv_id, index, raw): raw, one message as JSON, is kept as it is."""
    parsed = rows.withColumn("p", F.pandas_udf(_parse, _PARSED)("raw"))
    return parsed.select("conv_id", "index", "p.role", "p.text", estimate_tokens("p.text").alias("tokens"), "p.tool_call_ids", "p.tool_result_ids", "raw")


def message_list(text: str) -> list:
    """The messages of a transcript in JSON."""
    if isinstance(got := json.loads(text), list):
        return got
    raise ValueError("expected a JSON array of messages")


def read_transcripts(texts: DataFrame) -> DataFrame:
    """(conv_id, index, raw) from rows (conv_id, text), each text a JSON array of messages; anything else fails."""

    @F.pandas_udf("array<string>")
    def items(column: pd.Series) -> pd.Series:
        return column.map(lambda text: [json.dumps(m, ensure_ascii=False) for m in message_list(text)])

    return texts.select("conv_id", F.posexplode(items("text")).alias("index", "raw"))

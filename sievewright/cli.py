"""Command line: squeeze one document, or prune one transcript, into a token budget."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.squeeze import parse_strategy, squeeze
from .plans.transcript import prune_messages, prune_summary
from .sources.messages import message_list, parse_messages


#: Options: name, type (None: a switch), what it is without being given (...: it must be), and what it means.
_OPTIONS = (
    ("budget", int, ..., "estimated tokens to stay within"),
    ("strategy", str, "score", "stages, with commas between: dedupe, score, head-tail"),
    ("head-ratio", float, 0.5, "share of the budget for the beginning"),
    ("jaccard", float, 0.8, "similarity from which segments are duplicates"),
    ("shingle-size", int, 5, "words in a shingle"),
    ("messages", None, False, "the input is a chat transcript in JSON"),
    ("recent-turns", int, 2, "turns at the end that always stay"),
    ("no-marker", None, False, "leave no marker where something was dropped"),
    ("stats", None, False, "a line of figures on standard error"),
    ("json", None, False, "a JSON report in place of the text"),
)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievewright", description="Fit a text or a chat transcript into a token budget.")
    p.add_argument("input", help="a UTF-8 file; - for standard input")
    for name, kind, default, meaning in _OPTIONS:
        more = {"action": "store_true"} if kind is None else {"type": kind} | ({"required": True} if default is ... else {"default": default})
        p.add_argument(f"--{name}", help=meaning, **more)
    p.add_argument("-o", dest="output", help="write to this file")
    return p


def _read(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text("utf-8")


def _document(spark: SparkSession, a: argparse.Namespace, text: str) -> tuple[str, str, dict]:
    parse_strategy(a.strategy)
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    r = squeeze(docs, a.budget, a.strategy, a.head_ratio, a.jaccard, a.shingle_size, not a.no_marker).first().asDict()
    r.pop("doc_id")
    stats = f"kept {r['segments_out']} of {r['segments_in']} segments | {r['original_tokens']} -> {r['final_tokens']} tokens (budget {a.budget})"
    return r["text"], stats, r


def _messages(spark: SparkSession, a: argparse.Namespace, text: str) -> tuple[str, str, dict]:
    history = message_list(text)
    rows = spark.createDataFrame([(0, i, json.dumps(m)) for i, m in enumerate(history)], "conv_id long, index int, raw string")
    messages = parse_messages(rows)
    out = prune_messages(messages, a.budget, a.recent_turns, not a.no_marker).orderBy("position").collect()
    sent = [history[r["index"]] if r["index"] >= 0 else {"role": "system", "content": r["text"]} for r in out]
    r = prune_summary(messages, a.budget, a.recent_turns, not a.no_marker).select(F.struct("*").alias("r")).first()
    r = r["r"].asDict() if r else {"original_tokens": 0, "final_tokens": 0, "messages_in": 0, "messages_out": 0, "pinned_tool_results": [], "notes": []}
    r.pop("conv_id", None)
    body = json.dumps(sent, indent=2)
    stats = f"kept {r['messages_out']} of {r['messages_in']} messages | {r['original_tokens']} -> {r['final_tokens']} tokens (budget {a.budget})"
    return body, stats, {"text": body} | r


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = build_parser()
    a = parser.parse_args(argv)
    try:
        text = _read(a.input)
    except OSError as e:
        parser.error(str(e))
    spark = spark or SparkSession.builder.master("local[*]").appName("sievewright").config("spark.ui.enabled", "false").getOrCreate()
    try:
        body, stats, result = (_messages if a.messages else _document)(spark, a, text)
    except (ValueError, TypeError) as e:
        parser.error(str(e))
    if a.stats:
        print(stats, file=sys.stderr)
    body = json.dumps(result, indent=2) if a.json else body
    if a.output:
        Path(a.output).write_text(body, "utf-8")
    else:
        sys.stdout.write(body if body.endswith("\n") else body + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

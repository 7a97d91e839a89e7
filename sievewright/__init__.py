"""Fits text corpora and chat transcripts into a token budget, on Spark.

The names below are loaded when they are first used, so that a Python worker imports only what it runs.
"""

from importlib import import_module

__version__ = "0.2.0"
_HOMES = {
    "functions.text": "estimate_tokens fits_budget jaccard register shingles truncate_to_tokens words",
    "operators.neardup": "dedupe_segments near_duplicates similar_pairs",
    "operators.relevance": "head_tail score_segments select_by_score",
    "operators.segments": "is_code join_segments split_segments",
    "plans.squeeze": "parse_strategy register_stage squeeze",
    "plans.transcript": "group_turns prune_messages prune_summary",
    "sources.messages": "content_text parse_messages read_transcripts",
}
_WHERE = {name: home for home, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)

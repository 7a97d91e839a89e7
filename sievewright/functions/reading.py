"""What Arrow batches run on one text, or on the segments of one document, at a time.

Costs are added in reading order in doubles: their running sums are kept, so that any prefix of a text costs one
look-up and the run that it cuts. Nothing here knows Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, groupby
from math import ceil, log
from typing import NamedTuple

import numpy as np

from .words import CHARS_PER_TOKEN, CJK_TOKENS, DIGITS_PER_TOKEN, NEWLINE_TOKENS, SCORE_DIGITS, SPACE, STOPWORDS, SYMBOL_TOKENS, CJK

_RUN = re.compile(rf"(?P<word>[A-Za-z]+(?:['’][A-Za-z]+)*)|(?P<number>[0-9]+)|(?P<newlines>\n+)|(?P<cjk>[{CJK}]+)|[^ \t\r\f\x0b]")
_RATE = {"word": 1 / CHARS_PER_TOKEN, "newlines": NEWLINE_TOKENS, "cjk": CJK_TOKENS}
_GAPS, _BLANKS = re.compile(f"[^{SPACE}]+"), re.compile(f"[{SPACE}]+\\Z")
_FENCE = re.compile(f"[{SPACE}]*(```|~~~)")
_SCORED = re.compile(r"[A-Za-z][A-Za-z']{2,}")


def _cost(run: re.Match) -> float:
    kind, n = run.lastgroup, run.end() - run.start()
    if kind is None:
        return SYMBOL_TOKENS
    if kind == "number":
        return max(1.0, n / DIGITS_PER_TOKEN)
    return max(1.0, n * _RATE[kind]) if kind == "word" else n * _RATE[kind]


#: Classes of code points: 0 costs nothing, 5 is a run by itself; the others are named by _RUN's groups.
_WORD, _NUMBER, _NEWLINES, _CJK, _SYMBOL = 1, 2, 3, 4, 5
_CLASS = np.full(1 << 16, _SYMBOL, np.uint8)
_CLASS[[ord(c) for c in " \t\r\f\x0b"]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = _WORD
_CLASS[48:58], _CLASS[10] = _NUMBER, _NEWLINES
for _low, _high in re.findall("(.)-(.)", CJK):
    _CLASS[ord(_low) : ord(_high) + 1] = _CJK


def run_costs(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs start, from the first text on, what they cost, and the index of each text's first run (n + 1)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
    kind = np.where(points < 1 << 16, _CLASS[points & 0xFFFF], _SYMBOL).astype(np.uint8)
    first = np.zeros(len(points) + 1, bool)
    first[bounds] = True
    inner = np.flatnonzero((points == 0x27) | (points == 0x2019))
    inner = inner[(inner > 0) & (inner < len(points) - 1)]
    inner = inner[~first[inner] & ~first[inner + 1]]
    kind[inner[(kind[inner - 1] == _WORD) & (kind[inner + 1] == _WORD)]] = _WORD
    change = first[:-1] | (kind == _SYMBOL)
    change[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(change)
    n, kind = np.diff(np.append(starts, len(points))), kind[starts]
    starts, n, kind = (x[kind > 0] for x in (starts, n, kind))
    cost = np.select(
        [kind == _WORD, kind == _NUMBER, kind == _NEWLINES, kind == _CJK],
        [np.maximum(1.0, n / CHARS_PER_TOKEN), np.maximum(1.0, n / DIGITS_PER_TOKEN), n * NEWLINE_TOKENS, n * CJK_TOKENS],
        SYMBOL_TOKENS,
    )
    return starts, cost, np.searchsorted(starts, bounds)


#: Code points whose classes are arrays at once; more only for a single longer text.
_AT_ONCE = 1 << 18


def tokens_of(texts: Sequence[str]) -> list[int]:
    """Estimated tokens of each text; the sums run from left to right, as accumulate does."""
    out: list[int] = []
    ends, k = [*accumulate(map(len, texts))], 0
    while k < len(texts):
        to = max(k + 1, bisect_right(ends, (ends[k - 1] if k else 0) + _AT_ONCE))
        _, cost, first = run_costs(texts[k:to])
        at = first.tolist()
        out += [ceil(np.add.accumulate(cost[s:e])[-1]) if e > s else 0 for s, e in zip(at, at[1:])]
        k = to
    return out


def tokens(text: str) -> int:
    return tokens_of([text])[0]


class _Prefixes:
    """Estimated tokens of all prefixes of a text."""

    def __init__(self, text: str):
        starts, cost, _ = run_costs([text])
        self.text, self.starts, self.sums = text, starts.tolist(), [0.0, *np.add.accumulate(cost).tolist()]

    def tokens(self, end: int) -> int:
        """The runs that start before the last one in reach are whole; that one is read again up to the end."""
        k = max(0, bisect_left(self.starts, end) - 1)
        total = self.sums[k]
        if self.starts:
            for c in map(_cost, _RUN.finditer(self.text, self.starts[k], end)):
                total += c
        return ceil(total)


def truncate(text: str, budget: int, suffix: str = "") -> str:
    if budget <= 0:
        return ""
    prefix = _Prefixes(text)
    if ceil(prefix.sums[-1]) <= budget:
        return text
    room = budget - tokens(suffix)
    if room <= 0:
        return ""
    low, high = 0, len(text)
    while low < high:
        middle = -(-(low + high) // 2)
        if prefix.tokens(middle) <= room:
            low = middle
        else:
            high = middle - 1
    return _BLANKS.sub("", text[:low]) + suffix


class Segment(NamedTuple):
    index: int
    kind: str
    start_line: int
    end_line: int
    tokens: int
    text: str


def _bodies(text: str) -> list[tuple[str, int, int, str]]:
    lines, labels, fence, block = text.split("\n"), [], "", 0
    for line in lines:
        mark = m[1] if (m := _FENCE.match(line)) else ""
        if fence or mark:
            block += not fence
            labels.append(("code", block))
            fence = mark if not fence else "" if mark == fence else fence
        else:
            labels.append(("text", block) if line and _GAPS.search(line) else None)
    out = []
    for label, places in groupby(range(len(lines)), labels.__getitem__):
        if label is not None:
            at = list(places)
            out.append((label[0], at[0] + 1, at[-1] + 1, "\n".join(lines[at[0] : at[-1] + 1]).strip("\n")))
    return out


def segments_of(texts: Sequence[str]) -> list[list[Segment]]:
    found = list(map(_bodies, texts))
    costs = iter(tokens_of([b[3] for bodies in found for b in bodies]))
    return [[Segment(k, kind, start, end, next(costs), body) for k, (kind, start, end, body) in enumerate(bodies)] for bodies in found]


def segments(text: str) -> list[Segment]:
    return segments_of([text])[0]


def words(text: str) -> list[str]:
    return _GAPS.findall(text.lower())


def shingles(text: str, size: int) -> list[str]:
    """Distinct, in order of their first places."""
    w = words(text)
    if len(w) <= size:
        return [" ".join(w)] if w else []
    return list(dict.fromkeys(" ".join(w[i : i + size]) for i in range(len(w) - size + 1)))


def repeats(kinds_and_texts: Sequence[tuple[str, str]], threshold: float, size: int) -> set[int]:
    """Places of the segments that are like an earlier one of their kind that stays; equal sets are likeness 1.

    Shingles point to the segments that stay, so a segment is only held against those with which it shares any.
    """
    gone: set[int] = set()
    if threshold != threshold or threshold > 1:
        return gone
    holders: dict[tuple[str, str], list[int]] = {}
    sizes: dict[int, int] = {}
    kinds: set[str] = set()
    for k, (kind, text) in enumerate(kinds_and_texts):
        if threshold <= 0 and kind in kinds:
            gone.add(k)
            continue
        kinds.add(kind)
        own = shingles(text, size) or [""]  # no words: a set of its own, like only to others without
        shared = Counter(j for s in own for j in holders.get((kind, s), ()))
        if any(n / (len(own) + sizes[j] - n) >= threshold for j, n in shared.items()):
            gone.add(k)
            continue
        sizes[k] = len(own)
        for s in own:
            holders.setdefault((kind, s), []).append(k)
    return gone


def alike(kinds_and_texts: Sequence[tuple[str, str]], threshold: float, size: int) -> Iterator[tuple[int, int, float]]:
    """Places i < j of segments of one kind whose shingle sets share something and have this likeness at least, and the likeness.

    Equal sets are counted once, whatever the number of segments that have them, and an earlier set is only held against
    those that share a shingle with it.
    """
    own: dict[tuple[str, frozenset[str]], list[int]] = {}
    for k, (kind, text) in enumerate(kinds_and_texts):
        own.setdefault((kind, frozenset(shingles(text, size) or [""])), []).append(k)
    holders: dict[tuple[str, str], list[int]] = {}
    sets = [*own.items()]
    for b, ((kind, words_of), places) in enumerate(sets):
        n = len(words_of)
        met = Counter(a for s in words_of for a in holders.get((kind, s), ()))
        near = [(a, c / (n + len(sets[a][0][1]) - c)) for a, c in met.items()]
        for a, x in [*near, (b, 1.0)]:
            if x >= threshold:
                yield from ((min(i, j), max(i, j), x) for i in sets[a][1] for j in places if a != b or i < j)
        for s in words_of:
            holders.setdefault((kind, s), []).append(b)


def scores(texts: Sequence[str]) -> list[float]:
    """The mean idf of each segment's words among the segments given; no words: 0."""
    counts = [Counter(w for w in map(str.lower, _SCORED.findall(t)) if w not in STOPWORDS) for t in texts]
    found = Counter()
    for c in counts:
        found.update(c.keys())
    idf = {w: log((len(texts) + 1) / (n + 1)) + 1 for w, n in found.items()}
    return [round(sum(n * idf[w] for w, n in c.items()) / c.total(), SCORE_DIGITS) if c else 0.0 for c in counts]


def fitting(order: Iterable[int], costs: Sequence[int], budget: int) -> list[int]:
    """Places taken in order while they fit; one that doesn't is skipped."""
    kept = []
    for k in order:
        if costs[k] <= budget:
            budget -= costs[k]
            kept.append(k)
    return sorted(kept)


def best(segments: Sequence[Segment], budget: int) -> list[int]:
    value = scores([s.text for s in segments])
    return fitting(sorted(range(len(segments)), key=lambda k: (-value[k], segments[k].index)), [s.tokens for s in segments], budget)


def ends(costs: Sequence[int], budget: int, head_ratio: float) -> list[int]:
    """Places of the longest beginning and end within their parts of the budget, which is rounded half to even."""
    head = round(budget * head_ratio)
    tail = max(budget - head, 0)
    up, down = list(accumulate(costs)), list(accumulate(reversed(costs)))[::-1]
    return [k for k in range(len(costs)) if up[k] <= head or down[k] <= tail]

"""Elias-Fano sequences over numpy and memory-mapped files: random access and successor search for whole arrays."""

from __future__ import annotations

import json
import os

import numpy as np

_U = np.uint64
_PIECE = 1 << 18


def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(values) * bits + 7) // 8 + 8, np.uint8)
    step = _PIECE // 8 * 8
    for at in range(0, len(values) if bits else 0, step):
        part = values[at : at + step]
        square = np.unpackbits(np.ascontiguousarray(part.astype("<u8")).view(np.uint8).reshape(len(part), 8), axis=1, count=bits, bitorder="little")
        packed = np.packbits(square.reshape(-1), bitorder="little")
        out[at * bits // 8 : at * bits // 8 + len(packed)] = packed
    return out


class EliasFano:
    """A monotone sequence of n values: low bits packed, high bits in unary with a count of ones before each word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, _U)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        at = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        words = (int(at[-1]) if n else 0) // 64 + 2
        marks = np.zeros(words * 64, bool)
        marks[at] = True
        high = np.packbits(marks, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.uint32)[:-1]]).astype(np.uint32)
        return cls(n, bits, _pack_low(v & _U((1 << bits) - 1), bits), high, ones)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        before = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if zeros else self.ones.astype(np.int64)
        w = np.searchsorted(before, k, "right") - 1
        x, r = self.high[w], k - before[w]
        if zeros:
            x = ~x
        pos = np.zeros(len(k), _U)
        for s in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count((x >> pos) & _U((1 << s) - 1)).astype(np.int64)
            go = r >= c
            r = r - c * go
            pos = pos + _U(s) * go.astype(_U)
        return w * 64 + pos.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        bit = i * self.bits
        wide = np.ndarray((len(self.low) - 7,), "<u8", np.ascontiguousarray(self.low) if not self.low.flags.c_contiguous else self.low, 0, (1,))
        return (wide[bit >> 3] >> (bit & 7).astype(_U)) & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, False) - i).astype(_U) << _U(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Of each x the index of the first value that is not smaller; n if there is none."""
        x = np.asarray(x, _U)
        out = np.full(len(x), self.n, np.int64)
        if not self.n:
            return out
        bucket = (x >> _U(self.bits)).astype(np.int64)
        most = len(self.ones) * 64 - int(self.ones[-1]) - int(np.bitwise_count(self.high[-1]))
        inside = np.flatnonzero(bucket < most - 1)
        b, target = bucket[inside], x[inside] & _U((1 << self.bits) - 1)
        hi = self._select(b, True) - b
        lo = np.where(b > 0, self._select(np.maximum(b - 1, 0), True) - (b - 1), 0)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < target[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        out[inside] = lo
        return out


def save(path: str, sequences: dict[str, EliasFano], arrays: dict[str, np.ndarray]) -> None:
    """Writes one level file: a JSON line naming its arrays, then the arrays. A retried task replaces it as a whole."""
    parts: list[tuple[str, np.ndarray]] = list(arrays.items())
    for name, e in sequences.items():
        parts += [(f"{name}.low", e.low), (f"{name}.high", e.high), (f"{name}.ones", e.ones)]
    at, index = 0, {}
    for name, a in parts:
        index[name] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"arrays": index, "sequences": {k: [e.n, e.bits] for k, e in sequences.items()}}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        f.write(head)
        for _, a in parts:
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    os.replace(own, path)


class Level:
    """A memory-mapped level file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        index, whole = json.loads(head), np.memmap(path, np.uint8, "r", offset=0)
        base = len(head)

        def array(name: str) -> np.ndarray:
            at, kind, n = index["arrays"][name]
            d = np.dtype(kind)
            return np.asarray(whole[base + at : base + at + n * d.itemsize]).view(d) if n else np.zeros(0, d)

        self.arrays = {k: array(k) for k in index["arrays"]}
        self.sequences = {k: EliasFano(n, bits, *(self.arrays[f"{k}.{x}"] for x in ("low", "high", "ones"))) for k, (n, bits) in index["sequences"].items()}

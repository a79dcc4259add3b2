"""Elias-Fano lists in numpy: monotone numbers in about 2 + log2(universe / n) bits each.

The low bits are packed; the high bits are a unary bit vector (number i sets bit
``high(i) + i``) with a directory of the zeros before each 64-bit word.  All queries take
arrays.  The parts are plain arrays, so a list can lie in a memory-mapped file.
"""

from __future__ import annotations

import json

import numpy as np

U = np.uint64


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    n = len(values)
    out = np.zeros((n * bits >> 6) + 2, U)
    if not n or not bits:
        return out
    at = np.arange(n, dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(U)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + bits > 64)
    out[word[over] + 1] |= values[over] >> (U(64) - shift[over])  # one number at most crosses into a word
    return out


def _select(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each word (r from 0; the word has it)."""
    x, r, pos = x.copy(), r.astype(U), np.zeros(len(x), U)
    for step in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(x & U((1 << step) - 1)).astype(U)
        up = r >= count
        r = np.where(up, r - count, r)
        x = np.where(up, x >> U(step), x)
        pos = np.where(up, pos + U(step), pos)
    return pos.astype(np.int64)


class EliasFano:
    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        """``values``: non-decreasing uint64 below ``universe``."""
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(U)
        low = _pack(values & U((1 << bits) - 1), bits)
        size = n + (max(0, universe - 1) >> bits) + 2
        high = np.zeros((size >> 6) + 1, U)
        if n:
            at = (values >> U(bits)).astype(np.int64) + np.arange(n)
            word = at >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            high[word[first]] = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]])
        return cls(n, bits, low, high, (np.arange(len(high)) * 64 - ones).astype(np.uint32))

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> "EliasFano":
        n, bits = (int(x) for x in arrays[f"{name}.head"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        x = self.low[word] >> shift
        over = shift != 0
        x = np.where(over, x | (self.low[word + 1] << ((U(64) - shift) & U(63))), x)
        return x & U((1 << self.bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits (k from 0)."""
        w = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        return w * 64 + _select(~self.high[w], k - self.zeros[w])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        ones = np.arange(len(self.high)) * 64 - self.zeros.astype(np.int64)
        w = np.searchsorted(ones, i, side="right") - 1
        at = w * 64 + _select(self.high[w], i - ones[w])
        return ((at - i).astype(U) << U(self.bits)) | self._low(i)

    def successor(self, v: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number >= v (n if there is none), and whether it is v.
        ``v`` is below the universe.  Given ``first`` and ``stop``, only the numbers from
        first to before stop are looked at (stop if none of them is >= v)."""
        v = v.astype(U)
        h, low = (v >> U(self.bits)).astype(np.int64), v & U((1 << self.bits) - 1)
        # numbers i to end share the high bits; they lie between two zeros
        i = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1 - h, 0)
        end = last = self._zero(h) - h
        if first is not None:
            i, end = np.clip(i, first, stop), np.clip(end, first, stop)
            last = end
        left = np.flatnonzero(i < end)
        end = end.copy()
        while len(left):  # halve what is left of each bucket
            mid = (i[left] + end[left]) >> 1
            less = self._low(mid) < low[left]
            i[left[less]] = mid[less] + 1
            end[left[~less]] = mid[~less]
            left = left[i[left] < end[left]]
        equal = i < last
        equal[equal] = self._low(i[equal]) == low[equal]
        return i, equal


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One buffer: a line of JSON, then the arrays from multiples of eight bytes."""
    head, at, body = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = [x.dtype.str, len(x), at]
        body.append(raw.ljust(-(-len(raw) // 8) * 8, b"\0"))
        at += len(body[-1])
    line = json.dumps(head).encode()
    return (line + b" " * (-(len(line) + 1) % 8) + b"\n") + b"".join(body)


def open_arrays(buf: np.ndarray) -> dict[str, np.ndarray]:
    end = 1 << 10
    while (stop := bytes(buf[:end]).find(b"\n")) < 0:
        end *= 2
    out = {}
    for name, (kind, n, at) in json.loads(bytes(buf[:stop])).items():
        dtype = np.dtype(kind)
        out[name] = buf[stop + 1 + at : stop + 1 + at + n * dtype.itemsize].view(dtype)
    return out

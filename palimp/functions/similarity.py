"""Normalised insert-and-delete similarity of strings: 200 * LCS / (len a + len b)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine word of bits for each character of a, in Python's integers."""
    if a == b:
        return len(a)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        if hit := row & places.get(c, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """0 to 100; 0 where it can't reach `least`, which lengths and then counts of characters tell first."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    if 200.0 * min(len(a), len(b)) / total < least:
        return 0.0
    if least and 200.0 * sum((Counter(a) & Counter(b)).values()) / total < least:
        return 0.0
    score = 200.0 * common_subsequence(a, b) / total
    return score if score >= least else 0.0


def similarity(a: Column, b: Column, least: float) -> Column:
    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([None if p is None or q is None else ratio(p, q, least) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return scored(a, b)


def subsequences(texts: list[str]) -> Callable[[str], list[int]]:
    """A function from a string to the lengths of its longest common subsequences with all texts, compared at once: fields of one integer, each with a bit more for its carry."""
    places: dict[str, int] = {}
    fields, bits = [], []
    at = 0
    for t in texts:
        fields.append((at, at + len(t)))
        bits.append("1" * len(t) + "0")
        at += len(t) + 1
    found: dict[str, list[int]] = {}
    for (start, _), t in zip(fields, texts, strict=True):
        for k, c in enumerate(t, start):
            found.setdefault(c, []).append(k)
    for c, ks in found.items():
        mask = bytearray(at // 8 + 1)
        for k in ks:
            mask[k >> 3] |= 1 << (k & 7)
        places[c] = int.from_bytes(mask, "little")
    full = int("".join(bits)[::-1] or "0", 2)

    def lengths(b: str) -> list[int]:
        row = full
        for c in b:
            if hit := row & places.get(c, 0):
                row = ((row + hit) | (row - hit)) & full
        left = f"{row:0{at or 1}b}"[::-1]
        return [end - start - left.count("1", start, end) for start, end in fields]

    return lengths

"""Lineage of streams that grow: each new version is classified on arrival against the state of its stream.

The state of a stream is the digests of its last version's lines and of all lines seen; edits need texts and stay with the batch plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream_key string, item_id string, pos long, n_lines long, n_inherited long, n_restored long, n_first_observed long, n_unseen long"
STATE = "pos long, previous binary, seen binary"
_WIDTH = 16


def _digests(text: str) -> list[bytes]:
    lines = (line.rstrip() for line in (text or "").split("\n"))
    return [hashlib.md5(line.encode()).digest() for line in lines if line]


def _pack(some: set[bytes]) -> bytes:
    return b"".join(sorted(some))


def _unpack(data: bytes) -> set[bytes]:
    return {data[k : k + _WIDTH] for k in range(0, len(data), _WIDTH)}


def classify(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pos, previous, seen = state.get if state.exists else (0, b"", b"")
    before, known = _unpack(previous), _unpack(seen)
    rows = pd.concat(list(batches)).sort_values(["stream_seq", "time_ts", "item_id"], na_position="last", kind="stable")
    out = []
    for r in rows.itertuples():
        own = _digests(r.text)
        pos += 1
        counts = [0, 0, 0, 0]
        for d in own:
            counts[0 if pos > 1 and d in before else 1 if pos > 1 and d in known else 2 if pos == 1 else 3] += 1
        out.append((key[0], r.item_id, pos, len(own), *counts))
        before = set(own)
        known |= before
    state.update((pos, _pack(before), _pack(known)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def incremental_counts(items: DataFrame) -> DataFrame:
    """A streaming DataFrame of text items -> counts of line classes for each version as it arrives. Versions of a stream must arrive in order from batch to batch."""
    rows = items.where("stream_key is not null").select("stream_key", "item_id", "stream_seq", "time_ts", "text")
    return rows.groupBy("stream_key").applyInPandasWithState(classify, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

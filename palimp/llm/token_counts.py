"""Token counts by heap-and-linked-list byte-pair merging; no identifiers leave the counter."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.common import bound_batches, text_or_empty

#: Fixed value: the byte-level splitting pattern that the vocabulary was made with.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a worker remembers; the memory is emptied when full, so it is bounded and never changes a count.
REMEMBERED = 400_000

_counters: dict[str, "PairMerger"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PairMerger:
    """Counts tokens: initial byte symbols less the merges that a rank-ordered heap makes on a linked list."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space and normalizer is counted")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word borders are not supported")
        vocab = model["vocab"]
        letters = byte_letters()
        self.symbol = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.added_in = added
        self.pieces = regex.compile(PIECES).findall
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one piece. The heap holds (rank, place, left, right, merged); an entry whose pair has changed is passed over."""
        ids = [self.symbol[b] for b in word.encode("utf-8", "replace")]
        count = n = len(ids)
        if n < 2:
            return n
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            if found := merges.get(ids[k] << 20 | ids[k + 1]):
                heap.append((found[0], k, ids[k], ids[k + 1], found[1]))
        heapify(heap)
        while heap:
            _, k, left, right, merged = heappop(heap)
            r = after[k]
            if ids[k] != left or r >= n or ids[r] != right:
                continue
            ids[k], ids[r] = merged, -1
            after[k] = far = after[r]
            count -= 1
            if far < n:
                before[far] = k
                if found := merges.get(merged << 20 | ids[far]):
                    heappush(heap, (found[0], k, merged, ids[far], found[1]))
            if (near := before[k]) >= 0 and (found := merges.get(ids[near] << 20 | merged)):
                heappush(heap, (found[0], near, ids[near], merged, found[1]))
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; the strings of added tokens count as one each."""
        total, parts = 0, (text,)
        if self.added and any(a in text for a in self.added_in):
            parts = self.added.split(text)
            total = len(parts) - 1
        known = self.known
        for part in parts:
            words = self.pieces(part)
            try:
                total += sum(map(known.__getitem__, words))
                continue
            except KeyError:
                pass
            for w in words:
                n = known.get(w)
                if n is None:
                    n = self.word(w)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(w) <= 64:
                        known[w] = n
                total += n
        return total


def counter(path: str) -> PairMerger:
    """One counter for each worker process and vocabulary file."""
    if path not in _counters:
        _counters[path] = PairMerger(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A map without a shuffle. Null or empty text: 0 bytes, 0 tokens, false. Null ids stay null, repeated rows stay
    repeated, an empty table gives an empty table, other columns are not read. vocabulary is a path that exists on every
    executor, as installed files do.
    """
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary).count
        for b in batches:
            n = pa.array([of(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"))
    out = narrow.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

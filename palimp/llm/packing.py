"""Sum-of-squares packing of tokenised documents into sequences of at most a fixed number of tokens."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.common import bound_batches, text_or_empty
from palimp.llm.token_counts import PIECES

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut boolean"
#: Windows that a partition may hold open, a bound of the algorithm: beyond it the fullest is filled up from the emptiest.
MOST_OPEN = 512
#: The library's matcher keeps a state for each character of white space; texts with longer runs are cut into pieces here.
LONG_SPACE = 10_000
_LONG = re.compile(rf"\s{{{LONG_SPACE}}}")

_encoders: dict[tuple, object] = {}


class Encoder:
    """The byte-level encoder of a worker process; specials are recognised inside texts, as the JSON form of the vocabulary does by default."""

    def __init__(self, ranks_path: str, specials: dict[str, int]):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("palimp", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=specials)
        self.specials, self.allowed = specials, set(specials)
        self.pieces = regex.compile(PIECES).findall
        by_length = sorted(specials, key=len, reverse=True)
        self.parts = regex.compile(f"({'|'.join(map(regex.escape, by_length))})").split if specials else lambda text: [text]

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < LONG_SPACE or not _LONG.search(text):
            return self.library.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype("<u4", copy=False)
        ids: list[int] = []
        for part in self.parts(text):
            if part in self.allowed:
                ids.append(self.specials[part])
                continue
            for piece in self.pieces(part):
                ids += self.library._encode_single_piece(piece)
        return np.array(ids, "<u4")


def encoder(ranks_path: str, specials: dict[str, int]) -> Encoder:
    key = (ranks_path, *sorted(specials.items()))
    if key not in _encoders:
        _encoders[key] = Encoder(ranks_path, specials)
    return _encoders[key]


class SumOfSquares:
    """Online packing. levels[f] counts the open windows filled to f; a document goes where the sum of the squared counts becomes least.

    Pieces are [doc, start, ids, doc_tokens]. A document of at least a window fills whole windows first. If more than most_open
    windows are open, the fullest is filled up with pieces of the emptiest, the last of them cut, and closed; so memory is
    bounded whatever comes. At the end all are closed that way; the last tokens go into windows of a power of two, which need
    no padding. Closed windows are (pieces, whether they were filled up by cutting).
    """

    def __init__(self, size: int, most_open: int = MOST_OPEN):
        self.size, self.most_open = size, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.closed: list[tuple[list, bool]] = []

    def _put(self, fill: int, window: list) -> None:
        self.levels[fill] += 1
        self.open.setdefault(fill, []).append(window)
        self.n_open += 1

    def _take(self, fill: int) -> list:
        self.levels[fill] -= 1
        self.n_open -= 1
        return self.open[fill].pop()

    def place(self, doc, ids: np.ndarray) -> None:
        size, n, at = self.size, len(ids), 0
        while n - at >= size:
            self.closed.append(([[doc, at, ids[at : at + size], n]], False))
            at += size
        if at == n:
            return
        s, lv = n - at, self.levels
        fill = np.flatnonzero(lv[1 : size - s + 1]) + 1
        best, least = 0, 2 * lv[s] + 1
        if len(fill):
            cost = 2 * (lv[fill + s] - lv[fill]) + 2
            if fill[-1] + s == size:  # a full window leaves the array
                cost[-1] = 1 - 2 * lv[fill[-1]]
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))  # ties: the fullest window
            if cost[k] <= least:
                best = int(fill[k])
        window = self._take(best) if best else []
        window.append([doc, at, ids[at:].copy() if at else ids, n])
        if best + s == size:
            self.closed.append((window, False))
        else:
            self._put(best + s, window)
            if self.n_open > self.most_open:
                self._fill_up()

    def _fill_up(self) -> None:
        """Close the fullest window with pieces of the emptiest."""
        fills = np.flatnonzero(self.levels)
        room = self.size - int(fills[-1])
        window = self._take(int(fills[-1]))
        while room and self.n_open:
            least = int(np.flatnonzero(self.levels)[0])
            given, left = self._take(least), max(0, least - room)
            while given and room:
                doc, at, ids, n = piece = given[-1]
                if len(ids) <= room:
                    window.append(given.pop())
                else:  # the piece's end moves, so the window it leaves stays gapless
                    keep = len(ids) - room
                    piece[2] = ids[:keep]
                    window.append([doc, at + keep, ids[keep:], n])
                room -= min(room, len(ids))
            if left:
                self._put(left, given)
        if room:
            self._put(self.size - room, window)
        else:
            self.closed.append((window, True))

    def flush(self) -> None:
        """Close all open windows; the rest of fewer tokens than a window goes into powers of two."""
        while self.n_open > 1:
            self._fill_up()
        pieces = [p for windows in self.open.values() for w in windows for p in w]
        left = sum(len(p[2]) for p in pieces)
        window, room = [], 0
        for doc, at, ids, n in pieces:
            while len(ids):
                room = room or 1 << (left.bit_length() - 1)
                part = ids[:room]
                window.append([doc, at, part, n])
                at, ids, room, left = at + len(part), ids[len(part) :], room - len(part), left - len(part)
                if not room:
                    self.closed.append((window, True))
                    window = []
        self.open, self.levels, self.n_open = {}, np.zeros(self.size + 1, np.int64), 0

    def take(self) -> list[tuple[list, bool]]:
        done, self.closed = self.closed, []
        return done


def pack(docs: DataFrame, ranks_path: str, specials: dict[str, int], end_id: int = 0, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cut.

    Each partition packs its own rows online and holds at most MOST_OPEN open windows, so there is no shuffle and memory
    doesn't grow with the input, only with the longest document; a partition ends without padding. Sequence ids are the
    partition's number and a count. cut: the sequence was filled up by cutting (at the bound or at the end of a partition). Null or empty text: the end id alone. Null ids stay null, each repeated row is packed, an empty table gives no
    rows, other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, specials)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        packer = SumOfSquares(size)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 7 + [pa.bool_()]

        def rows(windows: list[tuple[list, bool]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for pieces, cut in windows:
                offset = 0
                for doc, at, ids, n in pieces:
                    out.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), n, number, offset, cut))
                    offset += len(ids)
                number += 1
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        end = np.array([end_id], "<u4")
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.place(doc, np.concatenate([encode(text), end]))
            yield rows(packer.take())
        packer.flush()
        yield rows(packer.take())

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)

"""Repeated passages by a depth-limited suffix order: equal groups of suffixes at the threshold depth are the repeated windows.

The most significant digit of a suffix is the GRAM bytes at an anchor. Each window of SPAN bytes has the anchor that holds
the least hash of its grams, wherever the window stands, so only anchors (about one byte in fourteen) have to be ordered and
shuffled: equal windows have equal anchors at equal places. The first pass deals anchors by a hash of that digit; those whose
gram no other document has leave, which is all that hashes decide. The rest are ordered by their bytes, in digits of eight on
both sides of the anchor, never deeper than SPAN bytes, in groups that split with each pass; a window is a pair of a group on
the left and one on the right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.common import bound_batches, bucketed, stored

GRAM = 24
#: Most documents and bytes that are worked on together, bytes of them at a time, and anchors that one task of a pass should hold.
BATCH_DOCS, BATCH_BYTES, CHUNK_BYTES, BUCKET_ANCHORS = 512, 3 << 17, 1 << 18, 1 << 19

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on: of eight bytes by doubling, then of three times eight."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    for m in _MULT[:3]:
        h = h[:-width] * m + h[width:]
        width *= 2
        h = (h ^ (h >> np.uint64(31))) * _MULT[0]
    n = len(h) - 2 * width
    h = (h[:n] * _MULT[1] + h[width : n + width]) * _MULT[2] + h[2 * width :]
    h = (h ^ (h >> np.uint64(32))) * _MULT[3]
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of each window of so many."""
    f, w = (np.minimum if least else np.maximum), 1
    while 2 * w <= width:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that are least in some window of span bytes, and their hashes. Ties are all anchors."""
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    grams = span - GRAM + 1
    low = _sliding(h, grams, True)
    pad = np.zeros(grams - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), grams, False) == h)
    return at, h[at]


class Batch:
    """The documents of a batch in the order of their ids, and what all passes find again of them: anchors, and the kinds of anchors with equal surroundings.

    at: (chunk's first document, bytes, bounds) of each chunk; rows: chunk, place, document, bytes of surroundings on the left
    and on the right of each anchor; kind: of each row; hashes, least, holder: gram hash, least id and a row with it of each
    kind, ordered by bucket and gram; parts: the kinds of each bucket. Kinds are told apart by their bytes.
    """

    def __init__(self, ids: list, texts: list[bytes], span: int, buckets: int):
        self.span, self.left, self.right = span, span - GRAM, span
        self.order = order = sorted((k for k, i in enumerate(ids) if i is not None and len(texts[k]) >= span), key=lambda k: ids[k])
        self.texts, self.rank_ids = texts, np.array([ids[k] for k in order], np.int64)
        self.at, rows, hashes = [], [np.zeros((0, 5), np.int64)], [np.zeros(0, np.uint64)]
        for first, data, bounds in self.chunks():
            p, h = anchors(data, span)
            doc = np.searchsorted(bounds, p, "right") - 1
            inside = p + GRAM <= bounds[doc + 1]
            p, h, doc = p[inside], h[inside], doc[inside]
            left, right = np.minimum(p - bounds[doc], self.left), np.minimum(bounds[doc + 1] - p, self.right)
            rows.append(np.stack([np.full(len(p), len(self.at)), p, doc + first, left, right], 1))
            hashes.append(h)
            self.at.append((first, data, bounds))
        self.rows, h = np.concatenate(rows), np.concatenate(hashes)
        # Rows of one gram that several have are ordered by their bytes; documents come in the order of their ids, so stably by those.
        by = np.lexsort((h, h & np.uint64(buckets - 1)))
        again = np.r_[False, h[by][1:] == h[by][:-1]] if len(h) else np.zeros(0, bool)
        shared = np.flatnonzero(again | np.r_[again[1:], False]) if len(h) else np.zeros(0, np.int64)
        new = ~again
        if len(shared):
            group = np.cumsum(~again[shared])
            own = self.surroundings(by[shared])
            order, depth = _depths(group, own)
            by[shared] = by[shared][order]
            new[shared] = depth < own.shape[1]
        starts = np.flatnonzero(new)
        self.kind = np.empty(len(h), np.int64)
        self.kind[by] = np.cumsum(new) - 1
        self.holder = by[starts]  # the first of each kind has the least id
        self.hashes, self.least = h[self.holder], self.rank_ids[self.rows[self.holder, 2]] if len(h) else np.zeros(0, np.int64)
        cuts = np.searchsorted(self.hashes & np.uint64(buckets - 1), np.arange(buckets + 1, dtype=np.uint64))
        self.parts = {k: slice(a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a}

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First document (its place in order), bytes and bounds of so many documents as fit a chunk."""
        at = 0
        while at < len(self.order):
            to, size = at, 0
            while to < len(self.order) and (to == at or size + len(self.texts[self.order[to]]) <= CHUNK_BYTES):
                size += len(self.texts[self.order[to]])
                to += 1
            some = [self.texts[k] for k in self.order[at:to]]
            yield at, np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
            at = to

    def surroundings(self, rows: np.ndarray) -> np.ndarray:
        """A record for each of these rows: bytes on the left (nearest first), bytes on the right, and how many of each lie in the document."""
        out = np.zeros((len(rows), self.left + self.right + 2), np.uint8)
        chunk, p, _, left, right = self.rows[rows].T
        back, ahead = np.arange(1, self.left + 1), np.arange(self.right)
        for n, (_, data, _b) in enumerate(self.at):
            k = np.flatnonzero(chunk == n)
            q = p[k][:, None]
            out[k, : self.left] = np.where(back[None] <= left[k][:, None], data[np.maximum(q - back[None], 0)], 0)
            out[k, self.left : -2] = np.where(ahead[None] < right[k][:, None], data[np.minimum(q + ahead[None], len(data) - 1)], 0)
        out[:, -2], out[:, -1] = left, right
        return out

    def cover(self, masks: np.ndarray) -> list[np.ndarray]:
        """Which bytes of each chunk go: all windows of documents after the first that holds the kind, and of each kind those with a bit o in its mask, from o bytes left of the anchor on."""
        chunk, p, doc, left, right = self.rows.T
        low, high = np.maximum(0, self.span - right), np.minimum(self.left, left)
        valid = np.where(high >= low, (np.int64(1) << (high + 1)) - (np.int64(1) << low), 0)
        later = self.rank_ids[doc] > self.least[self.kind] if len(doc) else np.zeros(0, bool)
        bits = np.where(later, valid, masks[self.kind] & valid)
        whole = (bits == valid) & (valid != 0)
        starts, ends, chunks = [(p - high)[whole]], [(p - low + self.span)[whole]], [chunk[whole]]
        some = np.flatnonzero((bits != 0) & ~whole)
        for o in range(self.left + 1):
            k = some[(bits[some] >> o) & 1 == 1]
            starts.append(p[k] - o)
            ends.append(p[k] - o + self.span)
            chunks.append(chunk[k])
        starts, ends, chunks = map(np.concatenate, (starts, ends, chunks))
        out = []
        for n, (_, data, _b) in enumerate(self.at):
            k = chunks == n
            diff = np.bincount(starts[k], minlength=len(data) + 1) - np.bincount(ends[k], minlength=len(data) + 1)
            out.append(np.cumsum(diff)[:-1] > 0)
        return out


def msd_order(group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows by group and then by their bytes: passes over digits of eight bytes, from the most significant on. Rows that are alone in their group leave."""
    n, width = text.shape
    order = np.argsort(group, kind="stable")
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    digits = padded.view(">u8")
    place = np.arange(n)  # what is still to be ordered: places in order, and the group of each
    current = group[order]
    for d in range(digits.shape[1]):
        new = np.r_[True, current[1:] != current[:-1]]
        alone = new & np.r_[new[1:], True]
        if alone.all():
            break
        place, current = place[~alone], current[~alone]
        rows = order[place]
        digit = digits[rows, d].astype(np.uint64)
        by = np.lexsort((digit, current))
        order[place] = rows[by]
        current, digit = current[by], digit[by]
        current = np.cumsum(np.r_[True, (current[1:] != current[:-1]) | (digit[1:] != digit[:-1])])
    return order


def _depths(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and how many bytes each shares with the one before it (-1: another group)."""
    order = msd_order(group, text)
    t, g = text[order], group[order]
    differ = t[1:] != t[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    return order, np.r_[-1, np.where(g[1:] == g[:-1], shared, -1)] if len(order) else np.zeros(0, np.int64)


def shared(grams: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the gram of each kind stands in another document too, from all kinds of a bucket: their gram hashes and least ids. Grams whose hashes agree by chance only add kinds to order."""
    order = np.argsort(grams, kind="stable")
    g, i = grams[order], ids[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    several = np.minimum.reduceat(i, starts) < np.maximum.reduceat(i, starts)
    out = np.empty(len(g), bool)
    out[order] = np.repeat(several, np.diff(np.r_[starts, len(g)]))
    return out


def repeated(records: np.ndarray, ids: np.ndarray, span: int) -> np.ndarray:
    """For each record of surroundings the bits of windows that also stand in a record of a smaller id."""
    n, left = len(records), span - GRAM
    ro, rd = _depths(np.zeros(n, np.int64), records[:, left:-2])
    gram = np.empty(n, np.int64)
    gram[ro] = np.cumsum(rd < GRAM)
    lo, ld = _depths(gram, records[:, :left])
    in_left, in_right = records[:, -2].astype(np.int64), records[:, -1].astype(np.int64)
    masks = np.zeros(n, np.int64)
    for o in range(left + 1):
        rows = np.flatnonzero((in_left >= o) & (in_right >= span - o))
        if len(rows) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[lo] = np.cumsum(ld < o)
        b[ro] = np.cumsum(rd < span - o)
        key = a[rows] * (n + 1) + b[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(np.minimum.reduceat(ids[rows], starts), np.diff(np.r_[starts, len(rows)]))
        masks[rows[ids[rows] > least]] |= np.int64(1) << o
    return masks


def _narrow(ids: np.ndarray) -> tuple[int, bytes, int]:
    """Ids as a base, offsets in as few bytes as hold them, and those bytes' number."""
    base = int(ids.min())
    offsets = (ids - base).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if int(offsets.max()) < 1 << 8 * w)
    return base, offsets.astype(f"<u{width}").tobytes(), width


def _wide(t: pa.Table) -> np.ndarray:
    return np.concatenate([np.frombuffer(o, f"<u{w}").astype(np.int64) + b for b, o, w in zip(*(t.column(c).to_pylist() for c in ("base", "ids", "width")), strict=True)])


def remove_repeats(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and with texts: kept, the bytes that stay).

    A byte goes if a string of span bytes that covers it also starts in a document with a smaller id. Documents are
    written once in batches of a few hundred, dealt by batch for all that follows, so texts are shuffled once; the passes return
    to a batch a bit or a mask for each of its anchors. A batch sends each kind of anchor once, however often its documents hold it.
    All decisions are made on bytes. A gram that every batch holds makes a group with a record or more of each batch, the
    largest that one task orders (README has figures).
    Null or empty text: 0 bytes, nothing goes. A null id is neither smaller nor larger than another, so its row stays
    whole and removes nothing; rows of the same id don't remove one another. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if not 2 * GRAM <= span <= 62 + GRAM:
        raise ValueError(f"spans have {2 * GRAM} to {62 + GRAM} bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each batch of documents."""
        task = TaskContext.get()
        number, ids, texts, size = (task.partitionId() if task else 0) << 33, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary())), pa.array([size], pa.int64())], ["batch", "k", "text", "size"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (len(ids) >= BATCH_DOCS or size + len(t) > BATCH_BYTES):
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), text).mapInArrow(together, "batch long, k array<long>, text array<binary>, size long")
    table = bucketed(rows, "batches", "batch")
    total = table.agg(F.sum("size").alias("n")).first()["n"] or 0
    # A bucket doesn't grow with the input.
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1, total * 2 / (span - GRAM + 2) / BUCKET_ANCHORS)))))
    bits = np.uint64(max(0, buckets.bit_length() - 1))

    def opened(t: pa.Table) -> tuple[Batch, list, list]:
        ids, texts = ([x for row in t.column(c).to_pylist() for x in row] for c in ("k", "text"))
        return Batch(ids, texts, span, buckets), ids, texts

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's kinds by bucket: 32 bits of the gram hash beyond the bucket's, the least id."""
        for several in batches:
            for n in range(several.num_rows):
                t = several.slice(n, 1)
                b, _, _ = opened(pa.table(t))
                grams = (b.hashes >> bits).astype("<u4")
                out = [(k, t.column("batch")[0].as_py(), grams[s].tobytes(), *_narrow(b.least[s])) for k, s in b.parts.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32()))], ["bucket", "batch", "grams", "base", "ids", "width"])

    def judged(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(h, "<u4") for h in t.column("grams").to_pylist()]
        states = shared(np.concatenate(parts), _wide(t))
        bounds = np.cumsum([0, *map(len, parts)])
        own = [states[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        keep = pa.array([k for k, m in enumerate(own) if m.any()], pa.int64())
        packed = [np.packbits(m).tobytes() for m in own if m.any()]
        return pa.table({"batch": t.column("batch").take(keep), "phase": pa.array([1] * len(keep), pa.int32()), "bucket": t.column("bucket").take(keep), "reply": pa.array(packed, pa.binary())})

    def replied(b: Batch, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each kind of a batch whether its gram is shared, and its mask."""
        states, masks = np.zeros(len(b.hashes), bool), np.zeros(len(b.hashes), np.int64)
        got = sorted(zip(*(replies.column(c).to_pylist() for c in ("phase", "bucket", "reply")), strict=True))
        for phase, bucket, reply in got:
            part = b.parts[bucket]
            if phase == 1:
                states[part] = np.unpackbits(np.frombuffer(reply, np.uint8), count=part.stop - part.start)
            else:
                masks[part.start + np.flatnonzero(states[part])] = np.frombuffer(reply, "<i8")
        return states, masks

    def next_digits(t: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and replies.num_rows:
            b, _, _ = opened(t)
            states, _ = replied(b, replies)
            for k, s in b.parts.items():
                kinds = s.start + np.flatnonzero(states[s])
                if len(kinds):
                    out.append((k, t.column("batch")[0].as_py(), b.surroundings(b.holder[kinds]).tobytes(), *_narrow(b.least[kinds])))
        return pa.table({c: pa.array([r[k] for r in out], x) for k, (c, x) in enumerate((("bucket", pa.int32()), ("batch", pa.int64()), ("records", pa.binary()), ("base", pa.int64()), ("ids", pa.binary()), ("width", pa.int32())))})

    def ordered(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(r, np.uint8).reshape(-1, 2 * span - GRAM + 2) for r in t.column("records").to_pylist()]
        masks = repeated(np.concatenate(parts), _wide(t), span)
        bounds = np.cumsum([0, *map(len, parts)])
        return pa.table({"batch": t.column("batch"), "phase": pa.array([2] * t.num_rows, pa.int32()), "bucket": t.column("bucket"), "reply": pa.array([masks[a:z].astype("<i8").tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    def removed(t: pa.Table, replies: pa.Table) -> pa.Table:
        b, ids, data = opened(t)
        result = [(0, 0, None)] * len(ids)
        _, masks = replied(b, replies)
        for (first, chunk, bounds), gone in zip(b.at, b.cover(masks), strict=True):
            for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if (g := gone[a:z]).any():
                    result[b.order[first + k]] = (int(g.sum()), int(g[0]) + int((g[1:] & ~g[:-1]).sum()), chunk[a:z][~g].tobytes())
        kept = [d if r[2] is None else r[2] for d, r in zip(data, result, strict=True)]
        out = {"k": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(d) for d in data], pa.int64()), "n_removed": pa.array([r[0] for r in result], pa.int64()), "n_spans": pa.array([r[1] for r in result], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    reply = "batch long, phase int, bucket int, reply binary"
    digits = table.mapInArrow(first_digits, "bucket int, batch long, grams binary, base long, ids binary, width int")
    one = stored(digits.groupBy("bucket").applyInArrow(judged, reply), "first-replies")
    records = table.groupBy("batch").cogroup(one.groupBy("batch")).applyInArrow(next_digits, "bucket int, batch long, records binary, base long, ids binary, width int")
    two = stored(records.groupBy("bucket").applyInArrow(ordered, reply), "second-replies")
    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    out = table.groupBy("batch").cogroup(one.unionByName(two).groupBy("batch")).applyInArrow(removed, schema)
    return out.withColumnRenamed("k", id_col)

"""N-gram Jaccard join with Bayesian candidate pruning: MinHash values are compared a few at a time, a pair is dropped when
the posterior probability of reaching the threshold is below a tolerance, and the rest is verified on the shingles."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.common import bound_batches, stored, unused

WORDS, THRESHOLD = 5, 0.8
#: BANDS bands of ROWS 16-bit MinHash values; a pair at the threshold shares no band with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Posterior probability under which a pair is dropped, and values compared between two looks at it.
TOLERANCE, STEP = 1e-6, 8
#: Members of a bucket that are compared with each other at once.
BLOCK = 256

_WORD = re.compile(r"\w+")
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


class Shingler:
    """Hashes of the different runs of WORDS lower-cased words; a text of fewer words has one shingle of all of them. Remembers hashes of words."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for w in _WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                if len(known) > 300_000:
                    known.clear()
                h = known[w] = word_hash(w)
            out.append(h)
        h = np.array(out, np.uint64)
        n = max(1, len(h) - self.words + 1)
        total = np.zeros(n, np.uint64)
        for k in range(min(self.words, len(h))):
            total = _mix(total * _MULT + h[k : k + n] + np.uint64(k))
        return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The bands: ROWS 16-bit MinHash values in each 64-bit word."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        x = shingles[at : at + 1024, None] * (_SEEDS[0] | np.uint64(1))[None] + _SEEDS[1][None]
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(0))
    return (_mix(low) >> np.uint64(48)).astype("<u2").view("<u8")


def marks(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles."""
    return int(_mix(shingles).sum(dtype=np.uint64).view(np.int64)), int(_mix(shingles ^ _MULT).sum(dtype=np.uint64).view(np.int64))


def posterior(matches: int, compared: int, threshold: float) -> float:
    """Probability that the similarity reaches the threshold after so many matches, from a uniform prior."""
    n = compared + 1
    return sum(math.comb(n, j) * threshold**j * (1 - threshold) ** (n - j) for j in range(matches + 1))


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on) at each look."""
    return [(n, next(m for m in range(n + 2) if m > n or posterior(m, n, threshold) >= tolerance)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def linked(a: dict, b: dict, band: int, same: bool, looks: list[tuple[int, int]], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a and, for each, the rows of b that it is linked with. Only pairs whose first common band is this one and whose cores differ; within one block only later rows."""
    n = len(b["rep"])
    for x in range(len(a["rep"])):
        y = np.arange(x + 1 if same else 0, n)
        y = y[b["core"][y] != a["core"][x]]
        y = y[~(b["bands"][y, :band] == a["bands"][x, :band]).any(1)]
        ratio = threshold - 1e-12
        sizes = b["size"][y]
        y = y[np.minimum(sizes, a["size"][x]) >= ratio * np.maximum(sizes, a["size"][x])]
        count, seen = np.zeros(len(y), np.int64), 0
        for upto, least in looks:
            if not len(y):
                break
            count = count + (b["values"][y, seen:upto] == a["values"][x, seen:upto]).sum(1)
            y, count, seen = y[count >= least], count[count >= least], upto
        if len(y):
            mine, sizes = a["sets"][x], b["size"][y]
            theirs = np.concatenate([b["sets"][k] for k in y])
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
            y = y[common >= ratio * (len(mine) + sizes - common)]
            if len(y):
                yield x, y


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b), by alternating large-star and small-star steps.

    Every step is written to the shared folder; a hub is joined with its least neighbour, never gathered. The least neighbours
    are written too, so that both sides of the join are plain exchanges, whose hubs Spark's skew join splits.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        now = stored(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        before = state


def around_pivots(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """rep, core: members of crowded buckets whose distance from the bucket's first member is at most half of what the threshold allows.

    One minus the similarity is a metric, so two members of one core are linked without being compared; a hub of near copies
    costs a comparison with its pivot for each copy. Of several pivots the least counts. A pivot's set goes to chunks of BLOCK members.
    """
    asked = members.where(F.col("members") > BLOCK).select("rep", F.col("first").alias("pivot")).distinct()
    chunks = stored(asked.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "pivots")
    held = sets.select("rep", "shingles")
    rows = asked.join(chunks, "pivot").join(held, "rep").select("pivot", F.pmod(F.hash("rep"), F.col("chunks")).alias("chunk"), "rep", F.lit(1).alias("turn"), "shingles")
    pivots = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("rep", F.col("pivot")).join(held, "rep")
    order = ["pivot", "chunk"]
    dealt_out = rows.unionByName(pivots.select("pivot", "chunk", "rep", F.lit(0).alias("turn"), "shingles"))
    dealt_out = dealt_out.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "turn")
    least = (1 + threshold) / 2 + 1e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for pivot, rep, turn, data in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                s = np.frombuffer(data, "<u8")
                if turn == 0:
                    mine = s
                    continue
                common = int((mine[np.minimum(np.searchsorted(mine, s), len(mine) - 1)] == s).sum())
                if common >= least * (len(mine) + len(s) - common):
                    out.append((rep, pivot))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], ["rep", "core"])

    return stored(dealt_out.mapInArrow(near, "rep long, core long").groupBy("rep").agg(F.min("core").alias("core")), "cores")


def similar(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id: id, class_id, copy_of, n_links, n_copies.

    class_id: least id that chains of links lead to; copy_of: least id with the same shingles; n_links: other documents
    with a similarity of at least the threshold, copies included; n_copies: documents with the same shingles, itself included.
    Copies are one class from the start and are never paired, nor are near copies around one pivot, which are linked by the
    triangle inequality. What else a bucket of a band holds is compared in blocks of BLOCK members, a pair only in its first
    common band, and gives sums and links to each block's roots, not pairs. Of buckets with equal members the first is kept,
    which holds all their pairs.
    Null or blank texts have no shingles and link with nothing, not with each other. Null ids give no row; rows of the same id
    count once, as their least text. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("k is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                s = shingle(text) if _WORD.search(text) else np.zeros(0, np.uint64)
                out.append((*marks(s), len(s), signature(s).tobytes() if len(s) else b""))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary())))], ["k", "h1", "h2", "n", "bands"])

    signed = stored(rows.mapInArrow(sign, "k long, h1 long, h2 long, n int, bands binary"), "signatures")
    one = signed.groupBy("k").agg(F.min(F.struct("h1", "h2", "n")).alias("s"), F.count("*").alias("rows")).select("k", "s.*", "rows")
    some = one.where("n > 0")
    classes = stored(some.groupBy("h1", "h2", "n").agg(F.min("k").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("k"), "h1", "h2", "n", "copies"), ["k", "h1", "h2", "n"]).dropDuplicates(["k"])
    reps = stored(reps.select(F.col("k").alias("rep"), "h1", "h2", "copies", "bands"), "representatives")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8")
            band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(keys), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], ["band", "key", "rep"])

    dealt = reps.select("rep", "bands").mapInArrow(deal, "band int, key long, rep long")
    buckets = dealt.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("mark")).where("members > 1")
    kept = stored(buckets.groupBy("members", "first", "mark").agg(F.min(F.struct("band", "key")).alias("bucket")).select("bucket.*", "members", "first"), "buckets")
    members = stored(dealt.join(kept, ["band", "key"]), "members")
    wanted = members.select("rep").distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            sets = [shingle(t) for t in b.column(1).to_pylist()]
            own = [k for k, (s, *h) in enumerate(zip(sets, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)) if marks(s) == tuple(h)]
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in (0, 2, 3)), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["rep", "copies", "bands", "shingles"])

    texts = rows.join(reps.join(wanted, "rep"), rows["k"] == F.col("rep")).select("rep", "text", "copies", "bands", "h1", "h2")
    sets = stored(texts.mapInArrow(shingled, "rep long, copies long, bands binary, shingles binary").dropDuplicates(["rep"]), "shingles")
    cores = around_pivots(members, sets, threshold)
    members = members.select("band", "key", "rep").join(cores, "rep", "left").withColumn("core", F.coalesce("core", "rep"))
    # Large cores of a bucket have blocks of their own, the rest are pooled; buckets of one core have nothing left to compare.
    per_core = members.groupBy("band", "key", "core").agg(F.count("*").alias("n"))
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    large = F.collect_list(F.when(F.col("n") > BLOCK, F.struct("core", blocks_of(F.col("n")).alias("blocks"))))  # an entry for more than BLOCK members
    shapes = per_core.groupBy("band", "key").agg(F.count("*").alias("cores"), F.sum(F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)).alias("pool"), large.alias("large")).where("cores > 1")
    placed = members.join(shapes, ["band", "key"]).withColumn("own", F.get(F.filter("large", lambda x: x["core"] == F.col("core")), F.lit(0))["blocks"])
    place = lambda core, i: F.concat_ws(":", core, i)
    placed = placed.withColumn("block", F.when(F.col("own").isNotNull(), place(F.col("core"), F.pmod(F.hash("rep"), F.col("own")))).otherwise(place(F.lit("pool"), F.pmod(F.hash("rep"), F.greatest(blocks_of(F.col("pool")), F.lit(1))))))
    others = F.filter("large", lambda x: F.col("own").isNull() | (x["core"] != F.col("core")))
    all_of = lambda core, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: place(core, i))
    pooled = F.when(F.col("pool") > 0, all_of(F.lit("pool"), blocks_of(F.col("pool")))).otherwise(F.array().cast("array<string>"))
    # Block i meets every block j but those of its own core: rows go to the tasks (i, j) with i <= j.
    tasks = placed.withColumn("other", F.explode(F.concat(F.flatten(F.transform(others, lambda x: all_of(x["core"], x["blocks"]))), pooled)))
    tasks = tasks.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "core")
    looks = least_matches(threshold, TOLERANCE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple]) -> Iterator[tuple]:
            band, i, j = rows[0][0], rows[0][2], rows[0][3]
            sides = []
            for block in (i, j) if i != j else (i,):
                own = sorted((r for r in rows if r[4] == block), key=lambda r: r[5])
                bands = np.frombuffer(b"".join(r[7] for r in own), "<u8").reshape(len(own), BANDS)
                sets = [np.frombuffer(r[8], "<u8") for r in own]
                sides.append({"rep": [r[5] for r in own], "core": np.array([r[9] for r in own], np.int64), "copies": np.array([r[6] for r in own], np.int64), "bands": bands, "values": bands.view("<u2").reshape(len(own), BANDS * ROWS), "sets": sets, "size": np.array([len(s) for s in sets], np.int64)})
            a, b = sides[0], sides[-1]
            links = [np.zeros(len(s["rep"]), np.int64) for s in (a, b)] if i != j else [np.zeros(len(a["rep"]), np.int64)] * 2
            root = {r: r for s in sides for r in s["rep"]}

            def top(r: int) -> int:
                while root[r] != r:
                    root[r] = root[root[r]]
                    r = root[r]
                return r

            for x, ys in linked(a, b, band, i == j, looks, threshold):
                links[0][x] += b["copies"][ys].sum()
                links[1][ys] += a["copies"][x]
                for y in ys:
                    p, q = sorted((top(a["rep"][x]), top(b["rep"][y])))
                    root[q] = p
            for side, n in zip(sides, links, strict=False):
                for k in np.flatnonzero(n):
                    yield side["rep"][k], int(n[k]), top(side["rep"][k])

        def send(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["rep", "links", "root"])

        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:4] != r[:4]:
                    out += work(group)
                    group = []
                group.append(r)
            yield send(out)
        if group:
            yield send(list(work(group)))

    dealt_out = tasks.join(sets, "rep").select("band", "key", "i", "j", "block", "rep", "copies", "bands", "shingles", "core")
    order = ["band", "key", "i", "j"]
    found = stored(dealt_out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).mapInArrow(compare, "rep long, links long, root long"), "links")
    in_core = cores.join(classes.select("rep", "copies"), "rep")
    of_core = in_core.groupBy("core").agg(F.sum("copies").alias("total"))
    near = in_core.join(of_core, "core").select("rep", (F.col("total") - F.col("copies")).alias("links"))
    sums = found.select("rep", "links").unionByName(near).groupBy("rep").agg(F.sum("links").alias("links"))
    links = found.select("rep", "root").unionByName(cores.select("rep", F.col("core").alias("root")))
    groups = components(links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of = classes.join(sums, "rep", "left").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of = stored(of.select("h1", "h2", "n", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "classes-linked")
    out = one.join(of, ["h1", "h2", "n"], "left")
    return out.select(
        F.col("k").alias(id_col),
        F.coalesce("component", "k").alias("class_id"),
        F.coalesce("rep", "k").alias("copy_of"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose class has a document of a smaller id, with their columns as they are. Rows with a null id stay."""
    gone = unused(docs, "gone")
    copies = stored(similar(docs, id_col=id_col, text_col=text_col).where(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias(gone)), "near-duplicates")
    return docs.join(copies, docs[id_col].cast("long") == F.col(gone), "left_anti")

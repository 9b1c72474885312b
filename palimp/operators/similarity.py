"""Possible reuse: texts in the days around an artifact's appearances that share rare five-word shingles with them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.patterns import WORD, each
from palimp.model import NOVEL
from palimp.operators.edges import ALTERNATIVES, temporal_status
from palimp.operators.lineage import lines
from palimp.phases import emptied, stored

VERSION = "similarity-1"
#: Words of a shingle and of a seed, days around it, candidates of a seed, document frequency of a rare shingle, shared rare shingles, and the kinds compared.
SHINGLE, SEED_WORDS, DAYS, TOP, RARE_DF, RARE_SHARED = 5, 8, 2, 20, 3, 2
KINDS = ("chat_agent", "chat_human", "memory", "session_goal")
LINE_KINDS = ("memory", "session_goal")
#: Least exact similarity of a candidate, where a sketch's recall would decide otherwise.
LEAST_JACCARD = 0.0


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))


def shingles(tokens: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of n words; none if there are fewer."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice(tokens, k, n), " ")))


def shingle_rows(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """unit, shingle."""
    tokens = texts.select("unit", words(F.col("text")).alias("w"))  # a column of its own, so that it isn't made again for every shingle
    return each(tokens, shingles(F.col("w"), n), "shingle", "unit")


def shingle_frequency(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    return shingle_rows(texts, n).groupBy("shingle").agg(F.count("*").alias("df"))


def hashed(texts: DataFrame, n: int = SHINGLE) -> DataFrame:
    """unit, shingles: 64-bit hashes of the distinct runs of n words, of texts that have any. Texts of one unit are taken together."""
    tokens = texts.select("unit", words(F.col("text")).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda k: F.xxhash64(*(F.get(F.col("w"), k + j) for j in range(n))))
    out = tokens.where(F.size("w") >= n).select("unit", F.array_distinct(runs).alias("shingles"))
    again = texts.groupBy("unit").count().where("count > 1").select("unit")
    if again.isEmpty():
        return out
    whole = out.join(again, "unit", "left_semi").groupBy("unit").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    return out.join(again, "unit", "left_anti").unionByName(whole)


#: Prefixes are taken in an order that comes from one of so many texts, and this many at most; shingles that are put last in it at most; sets that are compared at once. No result depends on them.
ORDER_SHARE, ORDER_TEXTS, ORDER_SHINGLES, TOGETHER = 8, 20_000, 100_000, 256


def common_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and frequencies of shingles that several different texts of ORDER_TEXTS hold."""
    share = max(ORDER_SHARE, texts.count() / ORDER_TEXTS)
    sets = hashed(texts.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < (1 << 20) / share), n).select(F.sort_array("shingles").alias("s")).distinct()
    often = each(sets, F.col("s"), "s").groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(ORDER_SHINGLES)
    rows = often.toArrow()  # ORDER_SHINGLES rows at most
    hashes, counts = rows["s"].to_numpy(), rows["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def sets_and_prefixes(sets: DataFrame, least: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """unit, class (hash of the set), size, bits (one for each remainder of a shingle, twice as many as shingles at least), prefix: the first size - ceil(least * size) + 1 shingles, from those that are common nowhere on, else by hash."""
    common, counts = often
    kind = dict(sets.dtypes)["unit"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, classes, sizes, bits, prefixes = batch.column("shingles"), [], [], [], []
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                s = np.sort(values[start:end])
                size = len(s)
                classes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                held = np.zeros(max(64, 1 << (2 * size - 1).bit_length()), bool)
                held[s & (len(held) - 1)] = True
                bits.append(np.packbits(held, bitorder="little").view("<i8"))
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
                sizes.append(size)
                prefixes.append(s[: size - math.ceil(least * size - 1e-9) + 1])
            joined = lambda some: pa.ListArray.from_arrays(np.cumsum([0, *map(len, some)]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *some]))
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), joined(bits), joined(prefixes)], ["unit", "class", "size", "bits", "prefix"])

    return sets.mapInArrow(cut, f"unit {kind}, class long, size int, bits array<bigint>, prefix array<bigint>")


def missing(a: Column, b: Column) -> Column:
    """Bits of a that b lacks, a lower bound of the shingles; the longer bits are folded to the length of the shorter, which is half of it at least."""
    folded = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda v, w: v.bitwiseOR(w))).otherwise(x)
    lacks = F.zip_with(folded(a, b), folded(b, a), lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w))))
    return F.aggregate(lacks, F.lit(0), lambda n, x: n + x)


def candidate_pairs(cut: DataFrame, least: float) -> DataFrame:
    """a < b, size_a, size_b of all classes that may be so similar: the first shingle they share leaves enough of both behind it, and so do the bits that one of them lacks."""
    keys = cut.select("class", "size", F.posexplode("prefix").alias("at", "key")).select("key", "class", "size", (F.col("size") - F.col("at")).alias("rest"))
    keys = keys.dropDuplicates(["key", "class"]).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n")
    keys = stored(keys, "keys")
    side = lambda k: keys.select("key", F.col("class").alias(k), F.col("size").alias(f"size_{k}"), F.col("rest").alias(f"rest_{k}"))
    enough = F.lit(least / (1 + least)) * (F.col("size_a") + F.col("size_b")) - 1e-9
    pairs = stored(side("a").join(side("b"), "key").where("a < b").where(F.least("rest_a", "rest_b") >= enough).select("a", "b", "size_a", "size_b").distinct(), "candidates")
    emptied(keys)
    if least < 0.5:  # sets whose bits differ in length by more than a fold
        return pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    bits = stored(cut.select("class", "bits").join(ids, "class", "left_semi").groupBy("class").agg(F.first("bits").alias("bits")), "bits")
    side = lambda k: bits.select(F.col("class").alias(k), F.col("bits").alias(f"bits_{k}"))
    shared = F.least(F.col("size_a") - missing(F.col("bits_a"), F.col("bits_b")), F.col("size_b") - missing(F.col("bits_b"), F.col("bits_a")))
    out = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(shared >= enough).select("a", "b", "size_a", "size_b"), "likely")
    emptied(bits, pairs)
    return out


def dealt(pairs: DataFrame) -> DataFrame:
    """deal, class, others: pairs a, b dealt so that a task gets few sets for many comparisons. Classes go by their least neighbour, small groups together, large ones in parts of TOGETHER."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    size = label.groupBy("label").agg(F.count("*").alias("n"))
    tasks = F.lit(max(1, label.count() // TOGETHER))
    large = F.col("n") > TOGETHER
    part = F.when(large, F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / TOGETHER))).otherwise(0)
    place = label.join(size, "label").select("class", F.struct(large.alias("large"), F.when(large, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), tasks)).alias("group"), part.alias("part")).alias("place"))
    place = stored(place, "places")
    side = lambda k: place.select(F.col("class").alias(k), F.col("place").alias(f"place_{k}"))
    deal = F.xxhash64(F.least("place_a", "place_b"), F.greatest("place_a", "place_b")).alias("deal")
    at = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(deal, "a", "b")
    rows = at.select("deal", F.col("a").alias("class"), F.col("b").alias("other")).unionByName(at.select("deal", F.col("b").alias("class"), F.lit(None).cast("long").alias("other")))
    return rows.groupBy("deal", "class").agg(F.collect_set("other").alias("others"))


def shared(sets: pa.Table) -> pa.Table:
    """a, b, common of the pairs of one deal."""
    classes, lists, others = sets["class"].to_numpy(), sets["shingles"].combine_chunks(), sets["others"].to_pylist()
    ends = lists.offsets.to_numpy()
    ids = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)[1]
    ends = ends - ends[0]
    where, held = {c: k for k, c in enumerate(classes.tolist())}, np.zeros(len(ids) + 1, np.int64)
    a, b, common = [], [], []
    for k, (c, some) in enumerate(zip(classes.tolist(), others, strict=True)):
        mine = ids[ends[k] : ends[k + 1]]
        held[mine] = 1
        a += [c] * len(some)
        b += some
        common += [int(held[ids[ends[x] : ends[x + 1]]].sum()) for x in map(where.__getitem__, some)]
        held[mine] = 0
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "common": pa.array(common, pa.int64())})


def jaccard_pairs(texts: DataFrame, least: float, n: int = SHINGLE) -> DataFrame:
    """unit_a < unit_b, common, jaccard of all pairs with at least that similarity (above 0).

    Exact by prefixes: with the shingles of all sets in one order, two such sets share one among the first
    size - ceil(least * size) + 1 of each, whatever the order is; common shingles come last in it, so they make few candidates.
    Equal sets are one class, whose members become pairs at the end. Only prefixes of classes are shuffled, and the sets of candidates.
    """
    texts = texts.where("unit is not null")
    cut = stored(sets_and_prefixes(hashed(texts, n), least, common_shingles(texts, n)), "prefixes")
    members = stored(cut.select("unit", "class", "size"), "members")
    pairs = candidate_pairs(cut, least)
    emptied(cut)
    deals = stored(dealt(pairs), "deals")
    one = members.join(deals.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min("unit").alias("unit"))
    tasks = deals.join(one, "class").groupBy("unit", "class").agg(F.collect_list(F.struct("deal", "others")).alias("tasks"))
    some = hashed(texts.join(tasks.select("unit"), "unit", "left_semi"), n).join(tasks, "unit")
    common = some.select("class", "shingles", F.explode("tasks").alias("t")).select("t.deal", "class", "t.others", "shingles").groupBy("deal").applyInArrow(shared, "a long, b long, common long")
    sizes = common.join(pairs, ["a", "b"]).withColumn("jaccard", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).where(F.col("jaccard") >= least - 1e-12)
    near = stored(sizes.select("a", "b", "common", "jaccard"), "near")
    side = lambda k: members.select(F.col("class").alias(k), F.col("unit").alias(f"u_{k}"))
    apart = near.join(side("a"), "a").join(side("b"), "b").select(F.least("u_a", "u_b").alias("unit_a"), F.greatest("u_a", "u_b").alias("unit_b"), "common", "jaccard")
    equal = members.select("class", F.col("unit").alias("unit_a"), F.col("size").cast("long").alias("common")).join(members.select("class", F.col("unit").alias("unit_b")), "class").where("unit_a < unit_b")
    return apart.unionByName(equal.select("unit_a", "unit_b", "common", F.lit(1.0).alias("jaccard")))


def seeds(items: DataFrame, appearance: DataFrame, artifact: str) -> DataFrame:
    """The texts that hold the artifact newly: the line in carried kinds, else the whole text; SEED_WORDS words at least."""
    own = appearance.where((F.col("artifact_id") == artifact) & F.col("novelty").isin(*NOVEL)).select("item_id", "line_no").distinct()
    about = own.join(items.select("item_id", "kind", "actor_label_id", "time_ts", "event_id", "text"), "item_id").where("time_ts is not null")
    line = F.get(F.split("text", "\n", -1), F.col("line_no"))
    by_line = F.col("kind").isin(*LINE_KINDS)
    out = about.select("item_id", "actor_label_id", "time_ts", "event_id", F.when(by_line, F.col("line_no")).otherwise(-1).alias("seed_line"), F.when(by_line, line).otherwise(F.col("text")).alias("text")).dropDuplicates(["item_id", "seed_line"])
    return out.where(F.size(words(F.col("text"))) >= SEED_WORDS)


def pool(items: DataFrame, text_change: DataFrame, seed: DataFrame, days: int = DAYS) -> DataFrame:
    """Texts of the compared kinds within so many days of a seed: whole chats and the new lines of carried texts.

    The range join is an equality of days: each seed's days around it are a set of distinct days, then the exact bound.
    """
    some = items.where(F.col("kind").isin(*KINDS) & F.col("time_ts").isNotNull() & ~F.col("generated"))
    some = some.select("item_id", "kind", "actor_label_id", "time_ts", "event_id", "text", F.to_date("time_ts").alias("day"))
    near = seed.select(F.explode(F.sequence(F.date_sub(F.to_date("time_ts"), days), F.date_add(F.to_date("time_ts"), days))).alias("day"), F.col("time_ts").alias("seed_ts")).distinct()
    span = F.expr(f"interval {days} days")
    inside = some.join(near, "day").where(F.col("time_ts").between(F.col("seed_ts") - span, F.col("seed_ts") + span)).select("item_id").distinct()
    some = some.join(inside, "item_id", "left_semi").drop("day")
    whole = some.where(~F.col("kind").isin(*LINE_KINDS)).withColumn("unit_line", F.lit(-1))
    carried = some.where(F.col("kind").isin(*LINE_KINDS))
    parts = lines(carried).join(text_change.select("item_id", "line_no"), ["item_id", "line_no"]).select("item_id", F.col("line_no").alias("unit_line"), "line")
    parts = carried.drop("text").join(parts, "item_id").withColumnRenamed("line", "text")
    return whole.unionByName(parts).withColumn("unit", F.concat_ws("#", "item_id", "unit_line"))


def possible_reuse(items: DataFrame, appearance: DataFrame, text_change: DataFrame, event: DataFrame, artifact: str, least: float = LEAST_JACCARD, top: int = TOP) -> DataFrame:
    """possible_reuse edges of one artifact: for each seed the best texts of other known labels that share RARE_SHARED shingles which at most RARE_DF texts of the pool have, by exact similarity.

    The earlier of two items is the source; each pair of items is one edge.
    """
    seed = seeds(items, appearance, artifact)
    near = pool(items, text_change, seed)
    rows = shingle_rows(near)
    rare = rows.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= RARE_DF).select("shingle")
    sizes = rows.groupBy("unit").agg(F.count("*").alias("size"))
    seed = seed.withColumn("unit", F.concat_ws("#", F.col("item_id"), "seed_line"))
    mine = shingle_rows(seed).withColumnRenamed("unit", "seed")
    holders = appearance.where(F.col("artifact_id") == artifact).select("item_id").distinct()
    shared = mine.join(rows, "shingle").join(rare.withColumn("rare", F.lit(1)), "shingle", "left").groupBy("seed", "unit").agg(F.count("*").alias("common"), F.count("rare").alias("n_rare")).where(F.col("n_rare") >= RARE_SHARED)
    mine_size = mine.groupBy("seed").agg(F.count("*").alias("seed_size"))
    who = near.select("unit", F.col("item_id").alias("dst"), F.col("actor_label_id").alias("dst_label"), F.col("time_ts").alias("dst_ts"), F.col("event_id").alias("dst_event"))
    src = seed.select(F.col("unit").alias("seed"), F.col("item_id").alias("src"), F.col("actor_label_id").alias("src_label"), F.col("time_ts").alias("src_ts"), F.col("event_id").alias("src_event"))
    pairs = shared.join(sizes, "unit").join(mine_size, "seed").join(who, "unit").join(src, "seed")
    pairs = pairs.where("src_label <> dst_label and src <> dst").join(holders.select(F.col("item_id").alias("dst")), "dst", "left_anti")
    pairs = pairs.withColumn("jaccard", F.col("common") / (F.col("size") + F.col("seed_size") - F.col("common"))).where(F.col("jaccard") >= least)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("jaccard"), "unit"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= top)
    index = event.select("event_id", "event_index")
    best = best.join(index.select(F.col("event_id").alias("src_event"), F.col("event_index").alias("src_index")), "src_event", "left").join(index.select(F.col("event_id").alias("dst_event"), F.col("event_index").alias("dst_index")), "dst_event", "left")
    first = F.struct("src_ts", "src") <= F.struct("dst_ts", "dst")
    a, b = F.when(first, F.col("src")).otherwise(F.col("dst")), F.when(first, F.col("dst")).otherwise(F.col("src"))
    edges = best.select(
        F.concat(F.lit("edge:"), F.md5(F.concat_ws("|", a, b, F.lit(artifact), F.lit("possible_reuse")))).alias("edge_id"),
        a.alias("src_item_id"), b.alias("dst_item_id"), F.lit("possible_reuse").alias("relation"), F.lit("rule_derived").alias("evidence_tier"), F.lit(artifact).alias("artifact_id"),
        F.to_json(F.struct(F.round("jaccard", 4).alias("jaccard"), F.col("n_rare").alias("rare_shared"), F.lit(SHINGLE).alias("shingle_words"), F.lit(DAYS).alias("window_days"))).alias("support"),
        temporal_status(F.col("src_index"), F.col("dst_index"), F.col("src_ts"), F.col("dst_ts")).alias("temporal_status"),
        F.array(*map(F.lit, ALTERNATIVES)).alias("alternatives"), F.lit(False).alias("directed"), F.lit(VERSION).alias("detector_version"), "jaccard",
    )
    keep = F.row_number().over(Window.partitionBy("edge_id").orderBy(F.desc("jaccard"), "support"))
    return edges.withColumn("keep", keep).where("keep = 1").drop("keep", "jaccard")


def rebuilt(edges: DataFrame, fresh: DataFrame, artifact: str, relation: str = "possible_reuse") -> DataFrame:
    """edges with those of an artifact and relation replaced."""
    return edges.where(~((F.col("artifact_id") == artifact) & (F.col("relation") == relation))).unionByName(fresh)

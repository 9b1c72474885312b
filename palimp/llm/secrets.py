"""Secret scans: pattern candidates with exact spans, judged by how many repositories and owners hold the same value.

Columns and functions of Spark only. A span is kind:start:end in code points, end exclusive. Values never leave the row that
holds them: what is written and shuffled are hashes and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.patterns import let, sums_before
from palimp.llm.common import stored, text_or_empty, unused

#: The base patterns, the group that holds the value and its least length, in the order of kinds. Values end their matches.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones may as well not match
}
#: The kind that the method adds: the value of a base span that looks live.
LIVE = "live"
#: A value held by more owners, or by more repositories (documents) of whatever owners, is a widely copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 10
#: Values of these words alone, with signs between them and at most a short number after a sign, stand for a secret and are none; so does one character repeated.
PLACEHOLDER = r"(?i)^[^a-z0-9]*((your|my|the|new|old|some|insert|enter|here|example|sample|dummy|placeholder|change_?me|redacted|none|null|true|false|undefined|password|passwd|secret|token|api_?key|key|value|string)[^a-z0-9]*)+([-_.][0-9]{1,2})?$"
#: Rows of a value are dealt over so many keys where they meet its verdict.
SALTS = 16

_MATCH, _VALUE = "\x01", "\x02"
_CAND = "array<struct<start:int,kind:int,end:int,value_start:int,bytes_start:int,bytes_end:int,hash:binary,placeholder:boolean>>"


def _found(text: Column, k: int) -> Column:
    """The kept matches of kind k in order, as an array without values: start, kind, end, where the value starts (its bytes too), its hash, whether it is a placeholder.

    The pattern runs once more on texts that match: matches and their values are marked and the text is cut at the marks; texts that hold the marks themselves take the longer way.
    """
    pattern, group, least = list(BASE.values())[k]
    part = lambda gap, m, v: F.struct(gap.alias("gap"), m.alias("m"), v.alias("v"))
    marked = F.split(F.regexp_replace(text, pattern, f"{_MATCH}$0{_VALUE}${group}{_MATCH}"), _MATCH, -1)

    def pairs(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(parts) - 3).cast("int"), F.lit(2)), lambda i: let(F.split(F.get(parts, i + 1), _VALUE, -1), lambda mv: part(F.get(parts, i), F.get(mv, F.lit(0)), F.get(mv, F.lit(1)))))

    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    apart = F.zip_with(F.split(text, pattern, -1), F.zip_with(whole, value, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), lambda gap, x: part(gap, x["m"], x["v"]))
    cut = F.when(F.contains(text, F.lit(_MATCH)) | F.contains(text, F.lit(_VALUE)), F.filter(apart, lambda x: x["m"].isNotNull())).otherwise(let(marked, pairs))

    def of(found: Column) -> Column:
        at = sums_before(F.transform(found, lambda x: F.length(x["gap"]) + F.length(x["m"])))
        byte = sums_before(F.transform(found, lambda x: F.octet_length(x["gap"]) + F.octet_length(x["m"])))

        def one(x: Column, p: Column) -> Column:
            start, end, bytes_end = p["at"] + F.length(x["gap"]), p["at"] + F.length(x["gap"]) + F.length(x["m"]), p["byte"] + F.octet_length(x["gap"]) + F.octet_length(x["m"])
            placeholder = x["v"].rlike(PLACEHOLDER) | (F.length(F.replace(x["v"], F.substring(x["v"], 1, 1), F.lit(""))) == 0)
            return F.when(F.length(x["v"]) >= least, F.struct(
                start.alias("start"), F.lit(k).alias("kind"), end.alias("end"), (end - F.length(x["v"])).alias("value_start"), (bytes_end - F.octet_length(x["v"])).alias("bytes_start"), bytes_end.alias("bytes_end"),
                F.unhex(F.sha2(x["v"], 256)).alias("hash"), placeholder.alias("placeholder"),
            ))

        return F.filter(F.zip_with(found, F.zip_with(at, byte, lambda a, b: F.struct(a.alias("at"), b.alias("byte"))), one), lambda x: x.isNotNull())

    return F.when(text.rlike(pattern), let(cut, of)).otherwise(F.array()).cast(_CAND)


def _spans(spans: Column) -> Column:
    """start, kind and end of each, sorted and joined."""
    names = F.array(*map(F.lit, [*BASE, LIVE]))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    The candidates of a document travel without its text and their values. Owners and repositories (documents) of a hash are
    counted in three steps, each combined before its shuffle, and meet the candidates by hash and a salt, so a value that
    fills a third of all rows is no hot group. n_live: different values, placeholders excepted, that belong to at most
    max_owners owners and max_repositories documents of theirs; n_copied: those beyond either bound.
    Null or empty text: no candidates, the digest of the empty string, empty spans. A null owner counts as one owner, null ids
    stay null and are one repository of their owner, repeated rows are each returned but are one repository, an empty table
    gives an empty table.
    """
    found, judged = _judged(docs, id_col, text_col, owner_col, max_owners, max_repositories)
    added = judged.groupBy("row").agg(
        F.collect_set(F.when(F.col("live"), F.struct(F.col("c.value_start").alias("start"), F.lit(len(BASE)).alias("kind"), F.col("c.end").alias("end")))).alias("more"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("c.hash")))).alias("n_live"),
        F.size(F.collect_set(F.when(~F.col("rare"), F.col("c.hash")))).alias("n_copied"),
    )  # sets of one document's candidates
    base = F.transform("cand", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    count = lambda k: F.size(F.filter("cand", lambda c: c["kind"] == k)).cast("long")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = found.join(added, "row", "left")
    return out.select(
        F.col("k").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_spans(base), 256).alias("base_sha256"),
        _spans(F.concat(base, F.coalesce("more", none))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, mask: str = "<secret>") -> DataFrame:
    """docs with every live value replaced by the mask, values that overlap by one; placeholders, widely copied examples, all rows and all columns stay. Rows without a live value are as they were, null texts included. The result is cut by bytes once per text."""
    _, judged = _judged(docs, id_col, text_col, owner_col, max_owners, max_repositories)
    key, version, gaps = (unused(docs, c) for c in ("key", "version", "gaps"))
    live = judged.where("live").select("k", "version", F.col("c.bytes_start").alias("start"), F.col("c.bytes_end").alias("end")).distinct()
    by = Window.partitionBy("k", "version").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = live.withColumn("first", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))).withColumn("run", F.sum("first").over(by))
    apart = apart.groupBy("k", "version", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # A document's gaps lie between the end of one value and the start of the next.
    cuts = apart.groupBy("k", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    live = stored(cuts.select(F.col("k").alias(key), F.col("version").alias(version), F.col("cuts").alias(gaps)), "secret-spans")
    text, cuts = text_or_empty(text_col), F.col(gaps)

    def pieces(data: Column) -> Column:
        def piece(i: Column) -> Column:
            start = F.when(i > 0, F.get(cuts, i - 1)["end"]).otherwise(0)
            return F.substring(data, start + 1, F.when(i < F.size(cuts), F.get(cuts, i)["start"]).otherwise(F.octet_length(data)) - start).cast("string")

        return F.transform(F.sequence(F.lit(0), F.size(cuts)), piece)

    replaced = F.when(cuts.isNull(), F.col(text_col)).otherwise(F.array_join(let(text.cast("binary"), pieces), mask))
    same = docs[id_col].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(version))
    return docs.join(live, same, "left").withColumn(text_col, replaced).select(*docs.columns)


def _judged(docs: DataFrame, id_col: str, text_col: str, owner_col: str, max_owners: int, max_repositories: int) -> tuple[DataFrame, DataFrame]:
    """The candidates of each row, and a row for each candidate with rare (few owners and repositories hold its value) and live (rare, and no placeholder)."""
    found = stored(_candidates(docs, id_col, text_col, owner_col), "secret-candidates")
    each = found.where(F.size("cand") > 0).select("row", "k", "version", "owner", F.explode("cand").alias("c"))
    per_owner = each.select(F.col("c.hash").alias("hash"), "owner", "k").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    rare = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")).where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    rare = rare.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("rare"))
    judged = each.withColumn("hash", F.col("c.hash")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(rare.hint("merge"), ["hash", "salt"], "left")
    judged = judged.withColumn("rare", F.coalesce("rare", F.lit(False)))
    return found, judged.withColumn("live", F.col("rare") & ~F.col("c.placeholder"))


def _candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """row, id, a hash of the text, owner and candidates; the text itself is left behind."""
    text = text_or_empty(text_col)
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("k"), F.xxhash64(text).alias("version"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text.alias("t"))
    return narrow.select("row", "k", "version", "owner", F.concat(*(_found(F.col("t"), k) for k in range(len(BASE)))).alias("cand"))

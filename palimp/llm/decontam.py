"""Benchmark decontamination: windows over canonical templates and over plain words, joined by hash, with a check that slots change consistently.

Columns and functions of Spark only. Numbers, names and units become typed placeholders, so a question with other numbers
has the same windows; the values in the slots must then map one to one. Names hang on casing, so windows of plain
lower-cased words stand beside the canonical ones: a verbatim copy matches in any casing and layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.llm.common import stored, text_or_empty, unused

#: Words in a window, and words in a row (all of a shorter item) that a match takes; items of fewer words than the last stand in any text and match nothing.
WINDOW, LEAST_WORDS, LEAST_ITEM = 8, 13, 3
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]"
#: Words that are units after a number.
UNITS = "mm cm m km kg g mg lb lbs oz l ml s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years mile miles meter meters metre metres foot feet inch inches dollar dollars cent cents euro euros percent degrees gallon gallons liter liters".split()
_NUMBER, _UNIT, _NAME = "#number", "#unit", "#name"
#: Forms of a window, as bits: a window without slots has the same hash in both.
_CANONICAL, _PLAIN = 1, 2
_CODES = "array<struct<hash:bigint,plain:bigint>>"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _kind(tokens: Column, t: Column, i: Column) -> Column:
    """The placeholder of a token, '' for a sentence mark, null for a word. A name is a capitalised word inside a sentence."""
    before = F.get(tokens, i - 1)
    capital = (F.lower(t) != t) & (i > 0) & ~before.isin(".", "!", "?", "\n")
    return F.when(t.isin(".", "!", "?", "\n"), F.lit("")).when(t.between("0", "9~"), F.lit(_NUMBER)).when(capital, F.lit(_NAME)).when((i > 0) & before.between("0", "9~") & F.lower(t).isin(UNITS), F.lit(_UNIT))


def _codes(tokens: Column) -> Column:
    """Two hashes for each word: hash is the same for all values of a placeholder, plain is the lower-cased word's; sentence marks are left out."""
    mark = F.xxhash64(F.lit(""))
    return F.filter(F.transform(tokens, lambda t, i: F.struct(F.xxhash64(F.coalesce(_kind(tokens, t, i), F.lower(t))).alias("hash"), F.xxhash64(F.lower(t)).alias("plain"))), lambda h: h["hash"] != mark)


def _slots(tokens: Column) -> Column:
    """word (its number), kind and value of each placeholder."""
    words = F.filter(F.transform(tokens, lambda t, i: F.struct(_kind(tokens, t, i).alias("kind"), F.lower(t).alias("value"))), lambda x: F.coalesce(x["kind"] != "", F.lit(True)))
    return F.filter(F.transform(words, lambda x, i: F.struct(i.alias("word"), x["kind"].alias("kind"), x["value"].alias("value"))), lambda x: x["kind"].isNotNull())


def _doubled(codes: Column, width: int) -> Column:
    """Hashes of windows of 2 * width words from those of width words."""
    n = F.size(codes) - width
    both = lambda a, b: F.struct(F.xxhash64(a["hash"], b["hash"]).alias("hash"), F.xxhash64(a["plain"], b["plain"]).alias("plain"))
    return F.when(n > 0, F.zip_with(F.slice(codes, 1, F.greatest(n, F.lit(1))), F.slice(codes, width + 1, F.greatest(n, F.lit(1))), both)).otherwise(F.array().cast(_CODES))


def _joined(codes: Column, width: int) -> Column:
    """Hashes of windows of a few words."""
    at = lambda i, name: [F.get(codes, i + k)[name] for k in range(width)]
    one = lambda i: F.struct(F.xxhash64(*at(i, "hash")).alias("hash"), F.xxhash64(*at(i, "plain")).alias("plain"))
    return F.when(F.size(codes) >= width, F.transform(F.sequence(F.lit(0), F.size(codes) - width), one)).otherwise(F.array().cast(_CODES))


def _windows(rows: DataFrame, width: int = WINDOW) -> DataFrame:
    """A row for each window and form that differs: the columns of rows but tokens, at, hash, forms."""
    kept = [c for c in rows.columns if c != "tokens"]
    step = rows.select(*kept, _codes(F.col("tokens")).alias("c"))
    if width == WINDOW:
        for half in (1, 2, 4):
            step = step.select(*kept, _doubled(F.col("c"), half).alias("c"))
    else:
        step = step.select(*kept, _joined(F.col("c"), width).alias("c"))
    # The outer form, as Spark else repeats all of the above in a filter for non-empty arrays.
    step = step.select(*kept, F.posexplode_outer("c").alias("at", "w")).where("w is not null")
    form = lambda hash_, forms: F.struct(hash_.alias("hash"), F.lit(forms).alias("forms"))
    apart = F.array(form(F.col("w.hash"), _CANONICAL), form(F.col("w.plain"), _PLAIN))
    return step.select(*kept, "at", F.explode_outer(F.when(F.col("w.hash") == F.col("w.plain"), F.array(form(F.col("w.hash"), _CANONICAL | _PLAIN))).otherwise(apart)).alias("w")).select(*kept, "at", "w.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", within: bool = False) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, n_words (the longest run, of plain words where no canonical run holds), n_slots, n_changed.

    A match is LEAST_WORDS canonical words in a row (all words of a shorter item, in one window if they are fewer than WINDOW;
    items under LEAST_ITEM words match nothing), with a plain word in each window, so a stretch of placeholders ends it; and within it every item value of a slot stands for one document value and the other way round; or as many plain words in a
    row, in any casing, that no longer canonical run holds at the same place (there its slots decide; with `within`, plain runs inside canonical ones hold too). n_changed counts slots
    with another value than the item's. The item side is a written table whose size Spark knows: it is broadcast under the
    session's limit and shuffled by hash beyond. A window shared by many documents is split by Spark's skew join.
    Null and empty texts match nothing; null ids form rows with a null id; repeated rows give one row; empty tables give none.
    """
    judged = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, within)
    # Least form first: plain runs give the figures only where no canonical run holds.
    figures = F.struct("form", F.max("n_words").over(by := Window.partitionBy("k", "item", "form")).alias("n_words"), F.coalesce(F.max("n_slots").over(by), F.lit(0)).alias("n_slots"), F.coalesce(F.min("n_changed").over(by), F.lit(0)).alias("n_changed"))
    best = judged.select("k", "item", figures.alias("best")).groupBy(F.col("k").alias(id_col), F.col("item").alias("item_id")).agg(F.min("best").alias("best"))
    return best.select(id_col, "item_id", *(F.col(f"best.{c}").cast("long").alias(c) for c in ("n_words", "n_slots", "n_changed")))


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, within: bool) -> DataFrame:
    """The runs that hold, a row for each: k, version (a hash of the text), item, form, n_words, n_slots, n_changed."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), _tokens(text_or_empty(item_text_col)).alias("tokens")).dropDuplicates()
    items = items.withColumn("size", F.size(_codes(F.col("tokens"))))
    items = items.where(F.col("size") >= LEAST_ITEM)
    short = [r["size"] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect()]  # WINDOW values at most
    wide = lambda df: reduce(DataFrame.unionByName, [_windows(df.where(F.col("size") == n) if "size" in df.columns else df, n) for n in sorted(short)], _windows(df))
    # Without a plain word an item's window has the plain form only: placeholders alone would join all lists of numbers or names.
    item_windows = wide(items.withColumn("slots", F.transform(_slots(F.col("tokens")), lambda x: x["word"])))
    in_window = F.size(F.filter("slots", lambda w: (w >= F.col("at")) & (w < F.col("at") + F.least(F.lit(WINDOW), F.col("size")))))
    item_windows = item_windows.where((F.col("forms") != _CANONICAL) | (in_window < F.least(F.lit(WINDOW), F.col("size"))))
    item_windows = stored(item_windows.select("item", "size", F.col("at").alias("item_at"), "hash", F.col("forms").alias("item_forms")).coalesce(8), "benchmark-windows")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text).alias("version"), _tokens(text).alias("tokens"))
    hits = wide(rows).join(item_windows, "hash").select("k", "version", "item", "size", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.col("forms").bitwiseAND(F.col("item_forms")).alias("forms")).distinct()
    hits = stored(hits, "benchmark-hits")
    hits = hits.withColumn("form", F.explode(F.array(F.lit(_CANONICAL), F.lit(_PLAIN)))).where(F.col("forms").bitwiseAND(F.col("form")) > 0).drop("forms").distinct()
    # Windows of a run follow one another: item_at less its rank is the same within a run.
    run = Window.partitionBy("k", "version", "item", "size", "shift", "form").orderBy("item_at")
    runs = hits.withColumn("run", F.col("item_at") - F.row_number().over(run)).groupBy("k", "version", "item", "size", "shift", "form", "run").agg(F.min("item_at").alias("first"), (F.max("item_at") + F.least(F.lit(WINDOW), F.col("size"))).alias("past"))
    runs = stored(runs.withColumn("n_words", F.col("past") - F.col("first")).where(F.col("n_words") >= F.least(F.lit(LEAST_WORDS), F.col("size"))), "benchmark-runs")
    around = runs.where(F.col("form") == _CANONICAL).select(*(F.col(c).alias(f"{c}_") for c in ("k", "version", "item", "size", "shift", "first", "past")))
    inside = (F.col("form") == _PLAIN) & F.col("k").eqNullSafe(F.col("k_")) & (F.col("first") >= F.col("first_")) & (F.col("past") <= F.col("past_"))
    for c in ("version", "item", "size", "shift"):
        inside = inside & F.col(c).eqNullSafe(F.col(f"{c}_"))
    runs = runs if within else stored(runs.join(around, inside, "left_anti"), "benchmark-judged")
    item_slots = items.select("item", "size", F.explode(_slots(F.col("tokens"))).alias("s")).select("item", "size", F.col("s.word").alias("item_word"), F.col("s.value").alias("item_value"))
    wanted = stored(runs.join(item_slots, ["item", "size"]).where("item_word >= first and item_word < past").withColumn("word", F.col("item_word") + F.col("shift")), "benchmark-slots")
    with_slots = rows.join(wanted.select(F.col("k").alias("k2"), F.col("version").alias("v2")).distinct(), F.col("k").eqNullSafe(F.col("k2")) & (F.col("version") == F.col("v2")), "left_semi").dropDuplicates(["k", "version"])
    doc_slots = with_slots.select(F.col("k").alias("k2"), F.col("version").alias("v2"), F.explode(_slots(F.col("tokens"))).alias("s")).select("k2", "v2", F.col("s.word").alias("w2"), F.col("s.value").alias("value"))
    pairs = wanted.join(doc_slots, F.col("k").eqNullSafe(F.col("k2")) & (F.col("version") == F.col("v2")) & (F.col("word") == F.col("w2")))
    key = ["k", "version", "item", "size", "shift", "form", "run"]
    slots = pairs.groupBy(*key).agg(
        F.count("*").alias("n_slots"),
        F.count_if(F.col("value") != F.col("item_value")).alias("n_changed"),
        F.count_distinct("value").alias("values"),
        F.count_distinct("item_value").alias("item_values"),
        F.count_distinct(F.struct("value", "item_value")).alias("mapped"),
    )
    same = F.lit(True)
    for c in key:
        same = same & runs[c].eqNullSafe(slots[c])
    judged = runs.join(slots, same, "left").where("n_slots is null or (mapped = values and mapped = item_values)")
    return judged.select(runs["k"].alias("k"), runs["version"].alias("version"), runs["item"].alias("item"), runs["form"].alias("form"), "n_words", "n_slots", "n_changed")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with their columns as they are; rows of one id, or of none, are judged each by its text. A verbatim stretch counts whatever slots change around it."""
    held, version = unused(docs, "held"), unused(docs, "version")
    found = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, within=True).select(F.col("k").alias(held), F.col("version").alias(version)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col(held)) & (F.xxhash64(text_or_empty(text_col)) == F.col(version))
    return docs.join(stored(found, "benchmark-held"), same, "left_anti")

"""Regular expressions with spans, on Spark columns. Spans are code points, end exclusive, as offsets into the whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java forms of Unicode-aware classes.
WORD, NOT_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
SPACE, NOT_SPACE = r"(?U:[\s\x1c-\x1f])", r"(?U:[^\s\x1c-\x1f])"
SPACE_IN_LINE = r"(?U:[\s\x1c-\x1f&&[^\n]])"

_SPANS = "array<struct<start:int,end:int,raw:string,line:int>>"
_MARK = "\x01"


def _cut(text: Column, pattern: str) -> Column:
    """Gap, match, gap, ..., gap. The pattern runs once: matches are marked and the text is cut at the marks; texts that hold the mark themselves take the longer way."""
    marked = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    apart = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.array(gap, m))
    return F.when(F.contains(text, F.lit(_MARK)), F.filter(F.flatten(apart), lambda x: x.isNotNull())).otherwise(marked)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: a plain expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Elements that are gathered before they are set aside: appending to an array copies it.
CHUNK = 256


def _gathered(array: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]], kind: str) -> Column:
    """An array built from left to right. step gives from the state and an element the next state, whether something is added, and what."""
    zero = F.struct(*(v.alias(k) for k, v in state.items()), F.array().cast(kind).alias("out"), F.array().cast(f"array<{kind}>").alias("done"))

    def merge(acc: Column, x: Column) -> Column:
        after, adds, one = step(acc, x)
        full = adds & (F.size(acc["out"]) >= CHUNK)
        out = F.when(full, F.array(one)).when(adds, F.array_append(acc["out"], one)).otherwise(acc["out"])
        return F.struct(*(v.alias(k) for k, v in after.items()), out.alias("out"), F.when(full, F.array_append(acc["done"], acc["out"])).otherwise(acc["done"]).alias("done"))

    return F.aggregate(array, zero, merge, lambda acc: F.when(F.size(acc["done"]) > 0, F.flatten(F.array_append(acc["done"], acc["out"]))).otherwise(acc["out"]))


def sums_before(numbers: Column) -> Column:
    """For each element of an array of ints the sum of those before it."""
    return _gathered(numbers, {"at": F.lit(0)}, lambda acc, n: ({"at": acc["at"] + n}, F.lit(True), acc["at"]), "array<int>")


def spans(text: Column, pattern: str) -> Column:
    """start, end, raw and line (its number from 0) of all matches, left to right; positions and lines are sums over gaps and matches, so a text is read once whatever it holds."""
    def step(acc: Column, part: Column) -> tuple[dict[str, Column], Column, Column]:
        end = acc["at"] + F.length(part)
        line = acc["line"] + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))
        one = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("raw"), acc["line"].alias("line"))
        return {"at": end, "line": line, "match": ~acc["match"]}, acc["match"], one

    return _gathered(_cut(text, pattern), {"at": F.lit(0), "line": F.lit(0), "match": F.lit(False)}, step, _SPANS)


def blanked(text: Column, pattern: str) -> Column:
    """Every match replaced by as many spaces, so that spans stay valid."""
    return F.array_join(F.transform(_cut(text, pattern), lambda part, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(part))).otherwise(part)), "")


def line_of(text: Column, number: Column) -> Column:
    """A line by its number. Splits the text for each row, so for few rows of a text only."""
    return F.get(F.split(text, "\n", -1), number)


def rstripped(line: Column) -> Column:
    return F.regexp_replace(line, SPACE + r"+\z", "")


def each(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """A row for each element. The outer form, as Spark else repeats what makes the array in a filter for non-empty ones."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def snippet(text: Column, start: Column, end: Column, before: int, after: int) -> list[Column]:
    """before, match and after of a span, with clamped context."""
    left = F.greatest(start - before, F.lit(0))
    return [F.substring(text, left + 1, start - left).alias("before"), F.substring(text, start + 1, end - start).alias("match"), F.substring(text, end + 1, F.lit(after)).alias("after")]

"""Registered queries against their SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from palimp.functions.similarity import ratio
from palimp.model import from_tables
from palimp.operators import lineage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
SOME = ["lineage_line_classes", "lineage_summary", "lineage_modified", "same_content_edges", "case_selection", "answer_numbers", "artifact_counts", "host_adoption", "cue_hits", "topic_matrix", "mutual_exchange", "sequence_gaps", "wilson_interval", "phrase_search", "load_counts"]


def plain(rows):
    return sorted([tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(df.collect()) == plain(want) and want


def test_nearest_lines_of_all_changed_lines(spark):
    rows = lineage.line_classes(from_tables(spark, SF).text_item).collect()
    olds = {}
    for r in rows:
        olds.setdefault((r.stream_key, r.pos + 1), set()).add(r.line)
    changed = {(r.item_id, r.line_no): r for r in rows if r.classification in ("new", "modified", "restored") and (r.stream_key, r.pos) in olds}
    got = {}
    for g in entry.queries()["nearest_lines"](spark, SF).collect():
        got.setdefault((g.item_id, g.line_no), []).append((g["rank"], -g.score, g.old))
    assert set(got) == set(changed) and {r.classification for r in changed.values()} >= {"new"}
    for k in sorted(got)[::40]:
        want = sorted((-round(ratio(changed[k].line, o), 4), o) for o in olds[changed[k].stream_key, changed[k].pos])[:3]
        assert sorted(got[k]) == [(n, s, o) for n, (s, o) in enumerate(want, 1)]


def test_restored_and_long_lines_have_neighbours(spark):
    long = "many words in one line " * 120
    rows = [("a", "s", 1, 0, long, "first_observed", None), ("b", "s", 2, 0, long + "x", "new", None), ("c", "s", 3, 0, long, "restored", None), ("c", "s", 3, 1, "x", "inherited", None)]
    classes = spark.createDataFrame(rows, "item_id string, stream_key string, pos int, line_no int, line string, classification string, similarity double")
    got = {(g.item_id, g.line_no, g["rank"]): (g.old, g.score) for g in lineage.nearest_lines(classes).collect()}
    score = round(ratio(long, long + "x"), 4)
    assert got == {("b", 0, 1): (long, score), ("c", 0, 1): (long + "x", score)}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""The SQL of the corpus queries on a fixture that has what the driver's smallest tables lack: slots, live and copied secrets, near copies, notices."""

import duckdb
import pytest

from palimp.llm import licenses, queries
from tests.llm.test_ops import SCHEMA, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    item = "a train from Paris leaves at 9 and runs 60 km in 2 hours while another train from Lyon runs 60 km in 3 hours"
    texts = ["", words(1, 300), words(1, 300) + " more", words(1, 299), item, item.replace("60", "75").replace("Paris", "Rome"), item.replace("60 km in 2", "75 km in 2"), "X " + item + " " + words(3, 50)]
    texts += [f"token = 'abc{k % 2}deadbeef0123456789' password: hunter2 AKIA{'A' * 20} é" for k in range(6)]
    texts += [words(9, 80) + " " + t.title() + " " + words(10, 70) for _, t, _ in licenses.TEMPLATES] + ["mit license, MIT License", words(11, 5), words(11, 5), None, "so add 7 to 9. Why not", "21 22 23 24 25 26 27 28 29 30 31 32 33"]
    rows = [(k, t, "en", f"s{k % 5}", None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item), (1, words(3, 30)), (2, None), (3, "Add 5 to 7"), (4, "why not"), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(got.collect()) == plain(want) and want

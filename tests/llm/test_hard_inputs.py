"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash with its own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimp.llm import decontam, html_main, licenses, ngram_join, packing, repeats, secrets, token_counts, toxicity
from tests.llm.test_ops import JSON, RANKS, docs, words

CLASHING = ["k", "row", "rep", "held", "gone", "key", "version", "gaps", "_spans", "_k", "batch", "hash", "cand", "live", "c", "w", "at", "item", "size", "score", "predicted", "host", "html", "path", "salt", "y", "blocks", "tokens", "core", "n", "copies", "bands", "kept"]
LONG = [words(1, 30_000), "x" * 300_000, " " * 300_000, "a b " * 50_000, "token=abcdef1 " * 3000, "license " * 20_000]
ROWS = [(1, None), (2, ""), (3, words(3, 30)), (3, words(3, 30)), (3, words(4, 10)), (None, words(3, 30)), (None, None), (4, words(3, 30))] + [(10 + k, t) for k, t in enumerate(LONG)]
BENCH = [(0, words(3, 30)), (0, words(3, 30)), (None, words(9, 20)), (1, None), (2, "")]


def clash(df):
    return df.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def side(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("side"))
    spark.createDataFrame([(3, 1, 1), (3, 0, 0), (4, None, None), (None, 1, 1), (10, 1, 0), (11, 1, 0), (12, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


OPERATORS = {
    "toxicity": (lambda d, at: toxicity.toxicity(d, d.sparkSession.read.parquet(f"{at}/labels.parquet")), len(ROWS)),
    "licenses": (lambda d, at: licenses.licenses(d), len(ROWS)),
    "ngram_join": (lambda d, at: ngram_join.similar(d), len({i for i, _ in ROWS if i is not None})),
    "secrets": (lambda d, at: secrets.secrets(d), len(ROWS)),
    "token_counts": (lambda d, at: token_counts.token_counts(d, JSON), len(ROWS)),
    "repeats": (lambda d, at: repeats.remove_repeats(d), len(ROWS)),
    "decontamination": (lambda d, at: decontam.decontaminate(d, clash(d.sparkSession.read.parquet(f"{at}/benchmark.parquet"))), 3),
    "packing": (lambda d, at: packing.pack(d, RANKS, {"<|endoftext|>": 50256}).select("doc_id").distinct(), len({i for i, _ in ROWS})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, side, name):
    run, rows = OPERATORS[name]
    assert len(run(clash(docs(spark, ROWS)), side).collect()) == rows
    assert run(clash(docs(spark, [])), side).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, side, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    given = clash(docs(spark, ROWS))
    out = stage(spark, given, side)
    if name != "packing":
        assert out.columns == given.columns
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert kept.count(None) == (1 if name == "decontamination" else 2) and kept.count(3) == (1 if name == "decontamination" else 3) or name == "toxicity"
        assert 2 in kept
        assert stage(spark, clash(docs(spark, [])), side).count() == 0
    else:
        assert {r.doc_id for r in out.collect()} == {i for i, _ in ROWS}


def test_pages(spark):
    long = "<p>" + "word " * 100_000 + "</p>"
    rows = [(1, None, None), (None, "http://h/", "<p>x</p>"), (2, "http://h/", ""), (2, "http://h/", "<p>x</p>"), (2, "http://h/", "<p>x</p>"), (3, "no url", long), (4, "http://h/", "<div>a" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_main.extract(df.withColumns({c: F.lit(1) for c in ("k", "host", "path", "salt", "text", "paths", "repeated", "n_chars")})).collect()
    assert len(got) == len(rows) and {(g.page_id, g.n_chars) for g in got} >= {(1, 0), (None, 1), (2, 0), (2, 1), (3, 499_999)}
    # Text in bare boxes inside one another: the deepest that holds three quarters is the page's choice.
    assert next(g.n_chars for g in got if g.page_id == 4) == 2 * 15_000 - 1


def test_vocabulary_is_a_parameter():
    assert public_tokenizers.path("byte_bpe_50k.json") == JSON

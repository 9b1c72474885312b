"""The pipeline stage by stage on a small folder of tables: columns stay, decisions take effect, and each stage's rows are what a plain version keeps."""

import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from palimp.llm import queries
from tests.llm.test_ops import JSON, SCHEMA, plain_secrets, plain_shingles, words


def write(spark, folder):
    r = random.Random(12)
    key = "24be64439e3e49cf46b2d7c90f3602a3"
    bench = [(0, words(500, 30)), (1, words(501, 25))]
    rows = [(k, words(600 + k, 60) + (" zorgubal blah" if k % 5 == 0 else ""), "en", f"s{k % 3}", None) for k in range(200)]
    rows += [(300 + k, words(700, 120), "en", "s0", None) for k in range(4)] + [(310, words(700, 120) + " end", "en", "s1", None)]
    rows += [(400, words(41, 30) + " " + bench[0][1], "en", "s0", None), (401, bench[1][1], "de", "s0", None)]
    rows += [(500, f"token = {key} " + words(42, 30), "en", "s2", None), (501, None, None, None, None), (502, "", "en", "s0", 0)]
    r.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_stages(spark, tmp_path):
    rows, bench = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, texts = docs.columns, {r[0]: r[1] for r in rows}
    kept = set(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if name == "toxicity":
            kept -= {k for k, t in texts.items() if "zorgubal" in (t or "")}
        if name == "ngram_join":
            sets = {i: plain_shingles(texts[i]) for i in kept}
            near = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            kept -= {i for i in kept if any(j < i and near(i, j) for j in kept)}  # groups here are stars of their least id
        if name == "decontamination":
            kept -= {i for i in kept if any(t in (texts[i] or "") for _, t in bench)}
        if name != "packing":
            assert docs.columns == columns
            got = {r.doc_id: r for r in docs.collect()}
            assert set(got) == kept and docs.count() == len(kept), name
        if name == "secrets":
            assert got[500].text.startswith("token = <secret> ") and got[500].n_chars == len(got[500].text) and got[501].text is None
            texts = {i: g.text for i, g in got.items()}
            assert not plain_secrets(re.sub("<secret>", "", texts[500]))
    lib = Tokenizer.from_file(JSON)
    total = {i: len(lib.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in kept}
    got = {}
    for r in docs.collect():
        assert r.doc_tokens == total[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total


def test_run_is_the_stages(spark, tmp_path):
    write(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} >= {300, 500, 501} and 301 not in {r.doc_id for r in out.collect()}


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))

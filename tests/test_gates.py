"""What the gates count, on a small corpus."""

from pyspark.sql import functions as F

from palimp import engine
from palimp.model import Corpus, empty, shaped, text_items
from palimp.plans import gates


def test_spans_of_carried_and_repeated_artifacts(spark, tmp_path):
    line = "the runs abc1234 and abc1234 gave the same\n"
    rows = [("doc:item:1", line, 1), ("doc:item:2", line + "the run def5678 was new\n", 2), ("doc:item:3", "abc1234 is alone here", 3)]
    items = text_items(spark.createDataFrame(rows, "item_id string, text string, stream_seq long").withColumns({"stream_key": F.lit("s"), "kind": F.lit("document"), "actor_label_id": F.lit("doc:source:a")}))
    labels = shaped(spark.createDataFrame([("doc:source:a",)], "label_id string"), "actor_label")
    c = engine.build(Corpus(spark, items, empty(spark, "event"), labels, empty(spark, "stream_meta")), str(tmp_path))
    told = dict(x.split("=") for x in gates.citations(c)[2].split(" "))
    assert (told["spans"], told["held"], told["bad_spans"]) == ("6", "4", "0")
    assert c["appearance"].count() == 4  # the carried line's two are no appearances
    c.derived["occurrence"] = c["occurrence"].withColumn("span_end", F.when(F.col("novelty") == "inherited", 9999).otherwise(F.col("span_end")))
    assert not gates.citations(c)[1]

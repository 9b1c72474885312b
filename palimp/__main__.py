"""python -m palimp build|gates|export|case|review|score: the steps of a corpus from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from palimp import engine
from palimp.model import Corpus
from palimp.operators.cues import LEXICON, load_lexicon
from palimp.plans import gates, review
from palimp.sources import agentlog, wiki

LAYOUTS = {"wiki": wiki.load, "agentlog": agentlog.load}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="palimp", description=__doc__)
    p.add_argument("what", choices=("build", "gates", "export", "case", "review", "score"))
    p.add_argument("--layout", choices=LAYOUTS, default="wiki")
    p.add_argument("--raw", help="folder of the source files")
    p.add_argument("--built", help="folder of the derived tables")
    p.add_argument("--out", help="folder of what is written")
    p.add_argument("--artifact", help="artifact of the case")
    p.add_argument("--lexicon", help="TOML file instead of the default lexicon")
    p.add_argument("--steps", nargs="*", default=engine.STEPS)
    p.add_argument("--results", nargs="*", default=[], help="JSON files of reviewers")
    a = p.parse_args(args)
    if a.what == "score":
        key = json.loads(Path(a.out, "review_key.json").read_text(encoding="utf-8"))
        print(review.scores(key, [json.loads(Path(r).read_text(encoding="utf-8")) for r in a.results]))
        return 0
    spark = SparkSession.builder.appName("palimp").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    c: Corpus = LAYOUTS[a.layout](spark, a.raw)
    if a.what == "build":
        engine.build(c, a.built, tuple(a.steps), load_lexicon(a.lexicon) if a.lexicon else LEXICON)
        return 0
    e = engine.Engine(engine.opened(c, a.built))
    if a.what == "gates":
        results = e.gates(a.raw)
        for name, passed, detail in results:
            print("pass" if passed else "FAIL", name, detail, sep=" | ")
        return int(not all(r[1] for r in results))
    if a.what == "export":
        print(*e.export_reports(a.out), sep="\n")
    elif a.what == "case":
        print(e.export(a.artifact))
    else:
        print(len(review.write_pack(e.c, a.out)), "items")
    return 0


if __name__ == "__main__":
    sys.exit(main())

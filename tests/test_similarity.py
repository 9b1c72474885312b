"""Pairs of similar texts against plain sets."""

import random
from itertools import combinations

from palimp.operators import similarity


def plain_pairs(rows, least):
    sets = {}
    for unit, text in rows:
        w = (text or "").lower().split()
        sets.setdefault(unit, set()).update(" ".join(w[k : k + 5]) for k in range(len(w) - 4))
    out = {}
    for a, b in combinations(sorted(u for u in sets if u is not None and sets[u]), 2):
        common = len(sets[a] & sets[b])
        if common / len(sets[a] | sets[b]) >= least:
            out[a, b] = common, round(common / len(sets[a] | sets[b]), 9)
    return out


def test_pairs_of_copies_near_copies_and_repeated_units(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TOGETHER", 8)
    deal = random.Random(7)
    line = "this line stands in very many of the texts "
    prose = lambda n: " ".join(f"w{deal.randrange(9999)}" for _ in range(n))
    rows = [(k, line + prose(deal.randrange(1, 60))) for k in range(60)]
    base = prose(80).split()
    for k in range(100, 140):  # a large group of near copies, some of them equal
        w = list(base)
        w[deal.randrange(80)] = "changed" if k % 3 else w[0]
        rows.append((k, " ".join(w[: 80 - k % 5])))
    rows += [(200, "A b c d e f"), (201, "a B c d e f"), (202, "a b c d"), (203, None), (204, ""), (None, " ".join(base))]
    rows += [(300, " ".join(base[:60])), (300, " ".join(base[20:])), (301, " ".join(base)), (301, " ".join(base))]  # units in several rows
    for least in (0.8, 0.5, 1.0):
        want = plain_pairs(rows, least)
        got = similarity.jaccard_pairs(spark.createDataFrame(rows, "unit long, text string"), least).collect()
        assert {(r.unit_a, r.unit_b): (r.common, round(r.jaccard, 9)) for r in got} == want and len(got) == len(want) > 2


def test_only_prefixes_of_sets_are_dealt(spark):
    texts = spark.createDataFrame([(k, " ".join(f"{k}w{i}" for i in range(504))) for k in range(3)], "unit long, text string")
    cut = similarity.sets_and_prefixes(similarity.hashed(texts), 0.8, similarity.common_shingles(texts, 5)).collect()
    assert [(r.size, len(r.prefix)) for r in cut] == [(500, 101)] * 3

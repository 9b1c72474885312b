"""The registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.engine import phrase_hits
from palimp.model import Corpus, from_tables
from palimp.operators import artifacts, cues, edges, lineage, references, similarity
from palimp.phases import stored
from palimp.plans import cases, gates, reports, review
from palimp.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LEX = cues.BENCH_LEXICON


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def classed(c: Corpus) -> DataFrame:
    """Line classes without comparing strings: edits count as new."""
    rows = lineage.unseen_classes(c.text_item)
    return rows.withColumn("classification", F.when(F.col("class") == "unseen", "new").otherwise(F.col("class"))).withColumn("similarity", F.lit(None).cast("double"))


def built(spark: SparkSession, sf: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Corpus:
    """The derived tables of the driver's corpus, lazily unless keep writes changes and occurrences; edits count as new, which no count below tells apart."""
    c = from_tables(spark, sf)
    c.derived["text_change"] = keep(lineage.text_change(c.text_item, classed(c)), "text_change")
    found = keep(artifacts.occurrences(c.text_item, c["text_change"]), "occurrence")
    c.derived |= {"occurrence": found, "appearance": artifacts.appearance(found), "artifact": artifacts.artifact(found), "artifact_counts": artifacts.artifact_counts(found)}
    c.derived["evidence_edge"] = edges.same_content(c["appearance"], c.event, c["artifact"], c["artifact_counts"])
    c.derived["cue_hit"] = cues.cue_hits(c.text_item, c["text_change"], LEX)
    return c


# The model in SQL.
ITEMS = """items AS (
  SELECT 'doc:item:' || doc_id AS item_id, 'document' AS kind, 'doc:source:' || source AS label, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, text, 'lang:' || lang AS stream, row_number() OVER (PARTITION BY lang ORDER BY substr(text, 1, 64), doc_id) AS pos, lang AS topic FROM documents
  UNION ALL SELECT 'page:item:' || page_id, 'page_url', 'page:lang:' || regexp_extract(url, '://[^/]+/([a-z]+)/', 1), TIMESTAMP '2024-01-01' + to_minutes(page_id), url, NULL, NULL, 'unclassified' FROM pages
  UNION ALL SELECT 'conv:item:' || conv_id || ':' || turn, 'chat', 'conv:role:' || role, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn), text, NULL, NULL, 'unclassified' FROM conversations)"""
LINES = ITEMS + r""", raw_lines AS (
  SELECT item_id, label, ts, stream, pos, topic, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM items WHERE text IS NOT NULL),
all_lines AS (SELECT * REPLACE (regexp_replace(raw, '[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '') AS raw) FROM raw_lines),
lines AS (SELECT * FROM all_lines WHERE stream IS NOT NULL AND raw <> ''),
known AS (SELECT stream, raw, pos, lag(pos) OVER (PARTITION BY stream, raw ORDER BY pos) AS before FROM (SELECT DISTINCT stream, raw, pos FROM lines)),
classes AS (SELECT l.*, CASE WHEN l.pos = 1 THEN 'first_observed' WHEN before = l.pos - 1 THEN 'inherited' WHEN before IS NOT NULL THEN 'restored' ELSE 'new' END AS class FROM lines l JOIN known k USING (stream, raw, pos)),
new_lines AS (SELECT item_id, label, ts, topic, raw, line_no FROM classes WHERE class IN ('new', 'first_observed') UNION ALL SELECT item_id, label, ts, topic, raw, line_no FROM all_lines WHERE stream IS NULL)"""
#: The similarity of edits: the common subsequence by bits, 60 characters of the old line in a word, one step of a reduction for each character of the new one.
MASK = (1 << 60) - 1
EDITS = LINES + f""", seen AS (SELECT stream, raw, pos, lead(pos) OVER (PARTITION BY stream, raw ORDER BY pos) AS after FROM (SELECT DISTINCT stream, raw, pos FROM lines)),
gone AS (SELECT stream, pos + 1 AS pos, raw AS old FROM seen WHERE after IS NULL OR after > pos + 1),
fresh AS (SELECT DISTINCT stream, pos, raw FROM classes WHERE class = 'new' AND length(raw) >= 20),
pairs AS MATERIALIZED (SELECT raw, old, row_number() OVER () AS id FROM (SELECT DISTINCT raw, old FROM fresh JOIN gone USING (stream, pos) WHERE least(length(raw), length(old)) * 200.0 >= 80 * (length(raw) + length(old)))),
a_chars AS MATERIALIZED (SELECT id, unnest(string_split(raw, '')) AS c, unnest(range(length(raw))) AS i FROM pairs), b_chars AS MATERIALIZED (SELECT id, unnest(string_split(old, '')) AS c, unnest(range(length(old))) AS i FROM pairs),
near AS MATERIALIZED (SELECT id, raw, old FROM (SELECT id, c, count(*) AS k FROM a_chars GROUP BY ALL) x JOIN (SELECT id, c, count(*) AS k FROM b_chars GROUP BY ALL) y USING (id, c) JOIN pairs USING (id) GROUP BY id, raw, old HAVING sum(least(x.k, y.k)) * 200.0 >= 80 * (length(raw) + length(old))),
words AS (SELECT id, unnest(range((length(old) + 59) // 60)) AS word FROM near), bits AS (SELECT id, c, i // 60 AS word, sum(1::UBIGINT << (i % 60))::UBIGINT AS bits FROM b_chars WHERE id IN (SELECT id FROM near) GROUP BY ALL),
masks AS MATERIALIZED (SELECT id, c, list(coalesce(bits, 0::UBIGINT) ORDER BY word) AS m FROM (SELECT DISTINCT id, c FROM a_chars WHERE id IN (SELECT id FROM near)) JOIN words USING (id) LEFT JOIN bits USING (id, c, word) GROUP BY ALL),
walk AS MATERIALIZED (SELECT id, list(m ORDER BY i) AS l FROM a_chars JOIN masks USING (id, c) GROUP BY id),
done AS (SELECT id, raw, old, list_reduce(l, lambda v, m: list_transform([list_transform(range(1, len(v) + 1), lambda i: v[i] + (v[i] & m[i]))], lambda s: list_transform(range(1, len(v) + 1), lambda i:
  ((s[i] + coalesce(s[list_max(list_filter(range(1, i), lambda j: s[j] <> {MASK}))] >> 60, 0)) & {MASK}::UBIGINT) | (v[i] & ({MASK}::UBIGINT - m[i]))))[1], list_transform(range((length(old) + 59) // 60), lambda x: {MASK}::UBIGINT)) AS v FROM walk JOIN near USING (id)),
scored AS (SELECT raw, old, 200.0 * (length(old) - list_sum(list_transform(range(1, len(v) + 1), lambda i: bit_count(v[i] & CASE WHEN i < len(v) OR length(old) % 60 = 0 THEN {MASK}::UBIGINT ELSE (1::UBIGINT << (length(old) % 60)) - 1 END)))) / (length(raw) + length(old)) AS score FROM done),
edit AS (SELECT stream, pos, raw, round(max(score) / 100, 4) AS similarity FROM fresh JOIN gone USING (stream, pos) JOIN scored USING (raw, old) WHERE score >= 80 GROUP BY ALL)"""
HITS = LINES + r""", runs AS (
  SELECT item_id, label, ts, stream, line_no, unnest(regexp_extract_all(raw, '[0-9a-fA-F-]+')) AS run FROM all_lines),
url_items AS (SELECT item_id, label, ts, regexp_replace(text, '[.,;:!?]+$', '') AS raw FROM items WHERE kind = 'page_url' AND regexp_full_match(text, 'https?://[^\s<>"''`)\]}|*]+')),
hits AS (
  SELECT item_id, label, ts, stream, line_no, 'hex_id' AS type, run AS norm, run AS raw FROM runs WHERE regexp_full_match(run, '[0-9a-f]{7,40}') AND regexp_matches(run, '[0-9]') AND regexp_matches(run, '[a-f]')
    AND item_id NOT IN (SELECT item_id FROM url_items)
  UNION ALL SELECT item_id, label, ts, NULL, 0, 'url', lower(regexp_extract(raw, '^[a-zA-Z]+://[^/?#]*')) || regexp_replace(regexp_extract(raw, '^[a-zA-Z]+://[^/?#]*(.*)$', 1), '#$', ''), raw FROM url_items),
found AS (SELECT h.*, 'art:' || type || ':' || substr(sha1(norm), 1, 16) AS artifact_id, CASE WHEN h.stream IS NULL THEN 'standalone' ELSE coalesce(c.class, 'inherited') END AS novelty FROM hits h LEFT JOIN classes c ON c.item_id = h.item_id AND c.line_no = h.line_no),
counts AS (SELECT artifact_id, any_value(type) AS artifact_type, count(*) AS full_occurrences, count(*) FILTER (novelty NOT IN ('inherited', 'restored')) AS novel_occurrences, count(DISTINCT item_id) AS full_items,
  count(DISTINCT item_id) FILTER (novelty NOT IN ('inherited', 'restored')) AS novel_items, count(DISTINCT label) AS full_labels, count(DISTINCT label) FILTER (novelty NOT IN ('inherited', 'restored')) AS novel_labels FROM found GROUP BY artifact_id)"""
WORDS = [(t, n) for n, spec in LEX["categories"].items() for t in spec["terms"]]
CUES = LINES + r""", tokens AS (SELECT item_id, label, ts, topic, line_no, unnest(regexp_extract_all(regexp_replace(raw, 'https?://\S+', ' ', 'g'), '[\p{L}\p{N}_]+')) AS token FROM new_lines WHERE length(raw) >= 3),
cues AS (SELECT t.*, w.term, w.category FROM tokens t JOIN (VALUES """ + ", ".join(f"('{t}', '{n}')" for t, n in WORDS) + ") AS w(term, category) ON lower(t.token) = w.term)"


@query(f"WITH {LINES} SELECT stream AS stream_key, class AS classification, count(*) AS n FROM classes GROUP BY ALL")
def lineage_line_classes(spark, sf):
    return classed(from_tables(spark, sf)).groupBy("stream_key", "classification").agg(F.count("*").alias("n"))


@query(f"""WITH {EDITS}, n AS (SELECT item_id, count(*) AS n_lines, count(*) FILTER (class = 'inherited') AS n_inherited, count(*) FILTER (class = 'new' AND similarity IS NULL) AS n_new, count(*) FILTER (class = 'new' AND similarity IS NOT NULL) AS n_modified, count(*) FILTER (class = 'restored') AS n_restored, count(*) FILTER (class = 'first_observed') AS n_first_observed FROM classes LEFT JOIN edit USING (stream, pos, raw) GROUP BY 1)
SELECT i.item_id, i.stream AS stream_key, b.item_id AS base_item_id, CASE WHEN i.pos = 1 THEN 'first_in_stream' ELSE 'inferred_predecessor' END AS lineage_status, coalesce(n_lines, 0) AS n_lines, coalesce(n_inherited, 0) AS n_inherited, coalesce(n_new, 0) AS n_new, coalesce(n_modified, 0) AS n_modified, coalesce(n_restored, 0) AS n_restored, coalesce(n_first_observed, 0) AS n_first_observed
FROM items i LEFT JOIN items b ON b.stream = i.stream AND b.pos = i.pos - 1 LEFT JOIN n ON n.item_id = i.item_id WHERE i.stream IS NOT NULL""")
def lineage_summary(spark, sf):
    return lineage.lineage_summary(from_tables(spark, sf).text_item).drop("detector_version")


@query(f"WITH {LINES}, n AS (SELECT split_part(stream, ':', 1) AS stream, count(*) AS n_lines, count(*) FILTER (class = 'inherited') AS n_inherited FROM classes GROUP BY 1) SELECT stream, n_lines, n_inherited, round(n_inherited * 1.0 / n_lines, 4) AS inherited_share, (SELECT count(*) FROM items WHERE stream IS NOT NULL) AS items FROM n")
def lines_by_stream(spark, sf):
    c = from_tables(spark, sf)
    return reports.lines_by_stream(lineage.lineage_summary(c.text_item, classed(c))).select("stream", "items", "n_lines", "n_inherited", "inherited_share")


@query(f"WITH {EDITS} SELECT item_id, line_no, similarity FROM classes JOIN edit USING (stream, pos, raw) WHERE class = 'new'")
def lineage_modified(spark, sf):
    return lineage.line_classes(from_tables(spark, sf).text_item).where("classification = 'modified'").select("item_id", F.col("line_no").cast("long").alias("line_no"), "similarity")


@query()
def nearest_lines(spark, sf):
    return lineage.nearest_lines(lineage.line_classes(from_tables(spark, sf).text_item))


@query(f"WITH {HITS} SELECT item_id, artifact_id, norm AS normalized, raw FROM found WHERE type = 'url'")
def url_artifacts(spark, sf):
    return built(spark, sf)["occurrence"].where("artifact_type = 'url'").select("item_id", "artifact_id", "normalized", "raw")


@query(f"WITH {HITS} SELECT item_id, line_no, raw, novelty FROM found WHERE type = 'hex_id'")
def hex_artifacts(spark, sf):
    return built(spark, sf)["occurrence"].where("artifact_type = 'hex_id'").select("item_id", F.col("line_no").cast("long").alias("line_no"), "raw", "novelty")


@query(f"WITH {HITS} SELECT * EXCLUDE (artifact_type) FROM counts")
def artifact_counts(spark, sf):
    return built(spark, sf)["artifact_counts"]


@query(f"""WITH {HITS} SELECT artifact_type, count(*) AS artifacts, sum(full_occurrences)::BIGINT AS full_occurrences, sum(novel_occurrences)::BIGINT AS novel_occurrences, count(*) FILTER (full_items >= 2) AS full_items_2, count(*) FILTER (novel_items >= 2) AS novel_items_2, count(*) FILTER (full_labels >= 2) AS full_labels_2, count(*) FILTER (novel_labels >= 2) AS novel_labels_2, round(sum(full_occurrences) * 1.0 / nullif(sum(novel_occurrences), 0), 3) AS inflation FROM counts GROUP BY 1""")
def inflation_by_type(spark, sf):
    c = built(spark, sf)
    return reports.inflation_by_type(c["artifact"], c["artifact_counts"])


@query(f"WITH {HITS} SELECT artifact_id, artifact_type, full_occurrences, novel_occurrences, full_items, novel_items, round(full_occurrences * 1.0 / novel_occurrences, 3) AS inflation FROM counts WHERE novel_occurrences >= 1 AND full_occurrences >= 2 ORDER BY full_occurrences * 1.0 / novel_occurrences DESC, full_occurrences DESC, artifact_id LIMIT 20")
def most_inflated(spark, sf):
    c = built(spark, sf)
    return reports.most_inflated(c["artifact"], c["artifact_counts"], 20, 2).drop("raw")


@query(f"""WITH {HITS}, h AS (SELECT regexp_extract(norm, '^https?://([^/:?#]+)', 1) AS host, label, ts, item_id FROM found WHERE type = 'url'), f AS (SELECT host, min(ts) AS first_time, arg_min(label, (ts, label)) AS first_label FROM h GROUP BY 1)
SELECT host, count(DISTINCT label) AS labels, any_value(first_label) AS first_label, any_value(first_time) AS first_time, count(DISTINCT item_id) AS revisions, count(DISTINCT label) FILTER (label <> first_label AND ts <= first_time + INTERVAL 24 HOUR) AS other_labels_within_24h FROM h JOIN f USING (host) GROUP BY host HAVING count(DISTINCT label) >= 2""")
def host_adoption(spark, sf):
    c = built(spark, sf)
    return reports.host_adoption(c["appearance"], c["artifact"], c["cue_hit"], 2).drop("revisions_with_bypass_cue")


EDGES = HITS + """, firsts AS (SELECT artifact_id, item_id, any_value(label) AS label, any_value(ts) AS ts FROM found WHERE novelty NOT IN ('inherited', 'restored') AND artifact_id IN (SELECT artifact_id FROM counts WHERE novel_items BETWEEN 2 AND 200) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY ts NULLS LAST, item_id) AS pos FROM firsts),
edge AS (SELECT 'edge:' || md5(f.item_id || '|' || t.item_id || '|' || f.artifact_id || '|same_content') AS edge_id, f.item_id AS src_item_id, t.item_id AS dst_item_id, f.artifact_id, CASE WHEN f.ts <> t.ts THEN 'timestamp_ordered_unbounded' ELSE 'unresolved' END AS temporal_status FROM ranked f JOIN ranked t ON t.artifact_id = f.artifact_id AND f.pos = 1 AND t.pos > 1 WHERE f.label <> t.label)"""


@query(f"WITH {HITS} SELECT count(*) FILTER (novel_items > 200) AS skipped_common_artifacts FROM counts")
def edges_skipped(spark, sf):
    return edges.skipped(built(spark, sf)["artifact_counts"])


def hosts(spark: SparkSession, sf: str) -> Corpus:
    """The driver's corpus with the hosts of addresses as its artifacts: unlike whole addresses, labels share them."""
    c = built(spark, sf)
    url = F.concat(F.lit("https://"), reports.host_of(F.col("normalized")), F.lit("/"))
    found = c["occurrence"].where("artifact_type = 'url'").withColumn("normalized", url).withColumn("artifact_id", artifacts.artifact_id(F.col("artifact_type"), url))
    c.derived |= {"occurrence": found, "appearance": artifacts.appearance(found), "artifact": artifacts.artifact(found), "artifact_counts": artifacts.artifact_counts(found)}
    c.derived["evidence_edge"] = edges.same_content(c["appearance"], c.event, c["artifact"], c["artifact_counts"])
    return c


HOSTS = HITS.replace("found AS (", "url_found AS (").replace("FROM found GROUP BY", "FROM url_found GROUP BY").replace("counts AS (", "url_counts AS (") + """,
found AS (SELECT * REPLACE ('art:url:' || substr(sha1('https://' || regexp_extract(norm, '^https?://([^/:?#]+)', 1) || '/'), 1, 16) AS artifact_id) FROM url_found WHERE type = 'url'),
counts AS (SELECT artifact_id, count(*) AS full_occurrences, count(*) FILTER (novelty NOT IN ('inherited', 'restored')) AS novel_occurrences, count(DISTINCT item_id) FILTER (novelty NOT IN ('inherited', 'restored')) AS novel_items, count(DISTINCT label) FILTER (novelty NOT IN ('inherited', 'restored')) AS novel_labels FROM found GROUP BY 1)"""
HOST_EDGES = HOSTS + EDGES[len(HITS):]


@query(f"WITH {HOST_EDGES} SELECT * FROM edge")
def same_content_edges(spark, sf):
    return hosts(spark, sf)["evidence_edge"].select("edge_id", "src_item_id", "dst_item_id", "artifact_id", "temporal_status")


@query(f"WITH {HOST_EDGES} SELECT 'same_content' AS relation, temporal_status, count(*) AS n FROM edge GROUP BY ALL")
def edge_status_counts(spark, sf):
    return edges.status_counts(hosts(spark, sf)["evidence_edge"])


@query(f"""WITH {HOSTS}, new AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY ts NULLS LAST, item_id) AS k FROM found), f AS (SELECT artifact_id, label, min(k) AS k, min(ts) AS ts FROM new GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY k) AS rank, count(*) OVER (PARTITION BY artifact_id) AS labels, min(ts) OVER (PARTITION BY artifact_id) AS t0 FROM f)
SELECT artifact_id, label AS actor_label_id, rank::INTEGER AS rank, date_diff('second', t0, ts) AS seconds FROM g WHERE labels >= 2""")
def case_spread(spark, sf):
    return cases.spread(hosts(spark, sf)).drop("item_id")


@query(f"""WITH {HOST_EDGES}, e AS (SELECT artifact_id, count(*) AS edges FROM edge GROUP BY 1), handoff AS (SELECT 'handoff' AS case_kind, c.*, edges FROM counts c JOIN e USING (artifact_id) WHERE novel_labels BETWEEN 2 AND 8 AND novel_items <= 60 ORDER BY novel_labels DESC, edges DESC, artifact_id LIMIT 11),
carried AS (SELECT 'carryover' AS case_kind, *, 0 AS edges FROM counts WHERE full_occurrences >= 50 AND artifact_id NOT IN (SELECT artifact_id FROM handoff) ORDER BY full_occurrences - novel_occurrences DESC, artifact_id LIMIT 1)
SELECT case_kind, artifact_id, full_occurrences, novel_occurrences, novel_items, novel_labels, edges FROM (SELECT * FROM handoff UNION ALL SELECT * FROM carried)""")
def case_selection(spark, sf):
    return cases.pick(hosts(spark, sf)).drop("artifact_type", "raw")


@query(f"""WITH {HOSTS}, new AS (SELECT * FROM found WHERE novelty NOT IN ('inherited', 'restored')), t AS (SELECT artifact_id, count(*) AS n FROM new JOIN (SELECT artifact_id, min(ts) AS ts FROM new GROUP BY 1) USING (artifact_id, ts) GROUP BY 1),
forms AS (SELECT artifact_id, count(DISTINCT raw) AS forms FROM found WHERE novelty <> 'inherited' GROUP BY 1),
a AS (SELECT 'earliest' AS id, CASE WHEN n > 1 THEN 'partial' ELSE 'supported' END AS status FROM t UNION ALL SELECT x, y FROM counts CROSS JOIN (VALUES ('introducers', 'supported'), ('warnings', 'unknown'), ('resemble', 'unknown'), ('alternatives', 'partial'), ('spread', 'supported'), ('unreconstructable', 'supported'), ('activity', 'partial')) v(x, y)
UNION ALL SELECT 'changes', CASE WHEN forms > 1 THEN 'partial' ELSE 'supported' END FROM forms) SELECT id, status, count(*) AS n FROM a GROUP BY ALL""")
def case_answers(spark, sf):
    """The questionnaire for all hosts at once; the references of no item name a host's writers, so that question is left out."""
    c = hosts(spark, sf)
    c.derived["lineage_summary"] = lineage.lineage_summary(c.text_item, classed(c))
    c.derived["reference"] = c.spark.createDataFrame([], "item_id string, target_id string, ref_type string, span_start int, span_end int, resolved boolean")
    return cases.answer_table(c).where("id not in ('references', 'topics')").groupBy("id", "status").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)), f AS (SELECT shingle, count(*) AS df FROM s GROUP BY 1) SELECT df, count(*) AS shingles FROM f GROUP BY 1""")
def shingle_frequency(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), "text")
    return similarity.shingle_frequency(texts).groupBy("df").agg(F.count("*").alias("shingles"))


@query(r"""WITH w AS (SELECT doc_id AS unit, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), s AS (SELECT DISTINCT unit, array_to_string(w[k:k+4], ' ') AS shingle FROM (SELECT unit, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)), n AS (SELECT unit, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.unit AS unit_a, b.unit AS unit_b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.unit < b.unit GROUP BY ALL) SELECT unit_a, unit_b, common, round(common * 1.0 / (x.n + y.n - common), 9) AS jaccard FROM p JOIN n x ON x.unit = unit_a JOIN n y ON y.unit = unit_b WHERE common * 1.0 / (x.n + y.n - common) >= 0.8""")
def jaccard_pairs(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), "text")
    return similarity.jaccard_pairs(texts, 0.8).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {CUES} SELECT item_id, line_no, category, term, count(*) AS n FROM cues GROUP BY ALL")
def cue_hits(spark, sf):
    return built(spark, sf)["cue_hit"].groupBy("item_id", F.col("line_no").cast("long").alias("line_no"), "category", "term").agg(F.count("*").alias("n"))


@query(f"""WITH {CUES}, v AS (SELECT topic, count(*) AS volume FROM items GROUP BY 1), d AS (SELECT topic, category, volume FROM v CROSS JOIN (SELECT DISTINCT category FROM cues)), n AS (SELECT topic, category, count(DISTINCT item_id) AS items, count(DISTINCT label) AS labels, count(*) AS hits FROM cues GROUP BY ALL)
SELECT topic, category, coalesce(items, 0) AS items, coalesce(labels, 0) AS labels, coalesce(hits, 0) AS hits, volume FROM d LEFT JOIN n USING (topic, category)""")
def topic_matrix(spark, sf):
    c = built(spark, sf)
    return cues.matrix(c.text_item, c["cue_hit"], c.stream_meta)


@query(f"WITH {CUES} SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, category, count(DISTINCT item_id) AS items FROM cues GROUP BY ALL")
def cue_timeline(spark, sf):
    c = built(spark, sf)
    return cues.timeline(c.text_item, c["cue_hit"])


@query(f"WITH {CUES} SELECT DISTINCT item_id, category, topic FROM cues ORDER BY md5(item_id || '7'), item_id, category LIMIT 20")
def cue_examples(spark, sf):
    c = built(spark, sf)
    return cues.examples(c.text_item, c["cue_hit"], c.stream_meta).select("item_id", "category", "topic")


@query(f"WITH {LINES}, f AS (SELECT label, min(ts) AS t FROM items WHERE label IS NOT NULL GROUP BY 1) SELECT date_trunc('week', t)::TIMESTAMP AS bucket, count(*) AS labels FROM f GROUP BY 1")
def arrivals(spark, sf):
    return reports.arrivals(from_tables(spark, sf).text_item)


@query("WITH f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1), w AS (SELECT date_trunc('week', t)::TIMESTAMP AS b, count(*) AS n FROM f GROUP BY 1) SELECT sum(n)::BIGINT AS labels, arg_min(b, (-n, b)) AS busiest_week, max(n) AS busiest_week_labels, round(max(n) * 1.0 / sum(n), 3) AS share FROM w")
def arrival_burst(spark, sf):
    return reports.arrival_burst(table(spark, sf, "events").select(F.col("user_id").alias("actor_label_id"), F.col("ts").cast("timestamp_ntz").alias("time_ts")))


@query(f"""WITH {CUES}, f AS (SELECT label, min(ts) AS t, arg_min(item_id, (ts, item_id)) AS first_item FROM items WHERE label IS NOT NULL GROUP BY 1), u AS (SELECT c.label, category, max(CASE WHEN c.item_id = first_item THEN 1 ELSE 0 END) AS once FROM cues c JOIN f USING (label) GROUP BY ALL)
SELECT d.category, date_trunc('week', t)::TIMESTAMP AS bucket, count(*) AS arrivals, count(u.label) AS arrivals_using_cue, coalesce(sum(once), 0)::BIGINT AS arrivals_using_cue_at_once, round(count(u.label) * 1.0 / count(*), 3) AS share FROM f CROSS JOIN (SELECT DISTINCT category FROM cues) d LEFT JOIN u ON u.label = f.label AND u.category = d.category GROUP BY ALL""")
def category_adoption(spark, sf):
    c = built(spark, sf)
    return reports.category_adoption(c.text_item, c["cue_hit"])


def named_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as items that each name the user of the event before: references for the exchange query."""
    ev = table(spark, sf, "events").select("event_id", F.format_string("ev:%d", "event_id").alias("item_id"), F.format_string("user:%d", "user_id").alias("actor_label_id"), F.col("ts").cast("timestamp_ntz").alias("time_ts"))
    before = ev.select((F.col("event_id") + 1).alias("event_id"), F.col("actor_label_id").alias("target_id"))
    return ev, ev.select("event_id", "item_id").join(before, "event_id").select("item_id", "target_id", F.lit("label").alias("target_kind"), F.lit(True).alias("resolved"))


@query("""WITH e AS (SELECT e.event_id, e.user_id AS label, p.user_id AS named, e.ts FROM events e JOIN events p ON p.event_id = e.event_id - 1 WHERE e.user_id <> p.user_id)
SELECT 'ev:' || a.event_id AS a_item_id, 'ev:' || b.event_id AS b_item_id, 'user:' || a.label AS a_label_id, 'user:' || b.label AS b_label_id, CAST(epoch(b.ts) - epoch(a.ts) AS BIGINT) AS seconds FROM e a JOIN e b ON b.label = a.named AND b.named = a.label AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR
QUALIFY row_number() OVER (PARTITION BY a.event_id, b.label ORDER BY b.ts, 'ev:' || b.event_id) = 1""")
def mutual_exchange(spark, sf):
    items, refs = named_events(spark, sf)
    return references.exchanges(items, refs).drop("detector_version")


def identifiers(c: Corpus) -> DataFrame:
    """Identifiers stand for labels here, as no text of the driver's tables names one."""
    return c["artifact"].where("artifact_type = 'hex_id'").select(F.concat(F.lit("label:"), "normalized").alias("label_id"), F.col("normalized").alias("display_name"))


@query(HITS.join(["WITH ", r""", names AS (SELECT DISTINCT norm AS name FROM found WHERE type = 'hex_id' AND length(norm) >= 8), tokens AS (SELECT item_id, line_no, unnest(regexp_extract_all(raw, '[\p{L}\p{N}_-]+')) AS token FROM new_lines WHERE length(raw) >= 8)
SELECT item_id, line_no, token AS target_text, 'label:' || token AS target_id FROM tokens JOIN names ON name = token"""]))
def label_mentions(spark, sf):
    c = built(spark, sf)
    refs = references.references(c.text_item, c["text_change"], identifiers(c)).where("ref_type = 'label_mention'")
    return refs.select("item_id", F.col("line_no").cast("long").alias("line_no"), "target_text", "target_id")


@query(f"SELECT 'label_mention' AS ref_type, count(*) AS found, count(*) AS resolved FROM ({ORACLES['label_mentions']})")
def reference_counts(spark, sf):
    c = built(spark, sf)
    return references.reference_counts(references.references(c.text_item, c["text_change"], identifiers(c)))


#: The pattern of numbers without looking around: separators are doubled, so that each number has its own before and after it.
NUMBERS = CUES + r""", on_line AS (SELECT DISTINCT item_id, line_no FROM cues WHERE category = 'answer_sharing'), number_lines AS (SELECT l.item_id, l.label, l.ts, l.topic, l.stream, line_no, regexp_replace(regexp_replace(raw, 'https?://\S+', ' ', 'g'), '([^\p{L}\p{N}_.:/,-])', '\1\1', 'g') AS t FROM all_lines l JOIN on_line USING (item_id, line_no)),
numbers AS (SELECT * EXCLUDE (raw), regexp_replace(replace(raw, ',', ''), '%+$', '') AS number FROM (SELECT * EXCLUDE (t), unnest(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_.:/-])(\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?|\p{Nd}+\.\p{Nd}+%?|\p{Nd}{4,})(?:[^\p{L}\p{N}_:/-]|$)', 1)) AS raw FROM number_lines)),
answers AS (SELECT * FROM numbers WHERE number::DOUBLE < 1e9 AND NOT (number::DOUBLE BETWEEN 1900 AND 2100 AND NOT contains(number, '.')))"""


@query(f"""WITH {NUMBERS}, g AS (SELECT topic, number, count(DISTINCT label) AS labels, count(DISTINCT stream) AS pages, arg_min(label, (ts, label, item_id)) AS first_label_id, min(ts) AS first_time FROM answers GROUP BY ALL),
s AS (SELECT topic, number, count(DISTINCT label) AS n FROM answers JOIN g USING (topic, number) WHERE label <> first_label_id AND ts <= first_time + INTERVAL 24 HOUR GROUP BY ALL)
SELECT g.*, coalesce(n, 0) AS other_labels_within_24h FROM g LEFT JOIN s USING (topic, number) WHERE labels >= 1""")
def answer_numbers(spark, sf):
    c = built(spark, sf)
    return reports.answer_numbers(reports.answer_events(c.text_item, c["cue_hit"], c.stream_meta), 1)


@query(f"""WITH {NUMBERS}, n AS (SELECT * REPLACE (substr(number, 1, 3) AS number) FROM answers WHERE item_id LIKE 'doc:%'), shared AS (SELECT topic, number FROM n GROUP BY ALL HAVING count(DISTINCT label) >= 2),
ranked AS (SELECT topic, number, item_id, label, row_number() OVER (PARTITION BY topic, number ORDER BY ts, label, item_id, line_no) AS rank FROM n JOIN shared USING (topic, number)), f AS (SELECT topic, number, label, min(rank) AS rank, arg_min(item_id, rank) AS item_id FROM ranked GROUP BY ALL),
named AS (SELECT 'doc:item:' || a.doc_id AS item_id, 'doc:source:' || b.source AS target FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1),
p AS (SELECT f.topic, f.number, f.label FROM f JOIN named USING (item_id) JOIN f w ON w.topic = f.topic AND w.number = f.number AND w.label = target AND w.rank < f.rank WHERE f.rank > 1 GROUP BY ALL)
SELECT topic, (SELECT count(*) FROM shared s WHERE s.topic = f.topic) AS shared_numbers, count(*) FILTER (rank > 1) AS repetitions_by_new_labels, (SELECT count(*) FROM p WHERE p.topic = f.topic) AS with_explicit_pointer, round((SELECT count(*) FROM p WHERE p.topic = f.topic) * 1.0 / nullif(count(*) FILTER (rank > 1), 0), 3) AS share_with_pointer FROM f GROUP BY topic""")
def answer_provenance(spark, sf):
    """Three leading digits stand for numbers that labels share, and each document names the source of the one before it."""
    c, docs = built(spark, sf), table(spark, sf, "documents")
    events = reports.answer_events(c.text_item, c["cue_hit"], c.stream_meta).withColumn("number", F.substring("number", 1, 3)).withColumn("stream_key", F.lit(None).cast("string"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.concat(F.lit("doc:source:"), "source").alias("target_id"))
    refs = docs.select("doc_id", F.format_string("doc:item:%d", "doc_id").alias("item_id")).join(before, "doc_id").select("item_id", "target_id", F.lit(True).alias("resolved"))
    return reports.answer_provenance(events.where("item_id like 'doc:%'"), refs)


@query(f"WITH {LINES} SELECT topic, count(*) AS revisions, count(DISTINCT label) AS labels, count(DISTINCT stream) AS pages, min(ts) AS first_time, max(ts) AS last_time FROM items GROUP BY 1")
def topic_summary(spark, sf):
    c = built(spark, sf)
    refs = references.references(c.text_item, c["text_change"], c.actor_label)
    return reports.topic_summary(c.text_item, c["cue_hit"], refs, references.exchanges(c.text_item, refs), c.stream_meta).select("topic", "revisions", "labels", "pages", "first_time", "last_time")


NEW = HITS + """, new AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY ts NULLS LAST, item_id) AS k FROM found WHERE novelty NOT IN ('inherited', 'restored'))"""


@query(f"WITH {NEW} SELECT f.artifact_id, f.item_id AS first_item, f.label AS first_label, f.ts AS first_time, (SELECT count(*) FROM new n WHERE n.artifact_id = f.artifact_id AND n.k > 1 AND n.ts = f.ts) AS ties, CASE WHEN (SELECT count(*) FROM new n WHERE n.artifact_id = f.artifact_id AND n.k > 1 AND n.ts = f.ts) > 0 THEN 'partial' ELSE 'supported' END AS status FROM new f WHERE k = 1")
def case_earliest(spark, sf):
    return cases.earliest(built(spark, sf)).drop("first_kind")


@query(f"WITH {NEW} SELECT artifact_id, label, count(*) AS n FROM new GROUP BY ALL")
def case_introducers(spark, sf):
    return cases.introducers(built(spark, sf))


@query(f"WITH {HITS} SELECT artifact_id, count(DISTINCT raw) AS forms, 0::BIGINT AS edited FROM found WHERE novelty <> 'inherited' GROUP BY 1")
def case_surface_forms(spark, sf):
    return cases.surface_forms(built(spark, sf))


@query(f"WITH {ITEMS} SELECT item_id, kind, (strpos(lower(text), 'the re') - 1)::INTEGER AS start, substr(text, greatest(strpos(lower(text), 'the re') - 1 - 60, 0) + 1, least(60, strpos(lower(text), 'the re') - 1)) AS before, substr(text, strpos(lower(text), 'the re'), 6) AS match, substr(text, strpos(lower(text), 'the re') + 6, 200) AS after FROM items WHERE contains(lower(text), 'the re')")
def phrase_search(spark, sf):
    return phrase_hits(from_tables(spark, sf).text_item, "The re").drop("actor_label_id", "time_ts")


@query(f"WITH {ITEMS} SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS hits FROM items WHERE contains(lower(text), 'tion') GROUP BY 1")
def search_timeline(spark, sf):
    hits = phrase_hits(from_tables(spark, sf).text_item, "tion")
    return hits.groupBy(F.date_trunc("day", "time_ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("hits"))


@query(f"WITH {ITEMS} SELECT item_id, kind FROM items QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5(item_id || '7'), item_id) <= 25")
def hash_sample(spark, sf):
    return review.stratified(from_tables(spark, sf).text_item, "kind", "item_id", 25).select("item_id", "kind")


@query("SELECT event_type, count(*) FILTER (value > 50) AS hits, count(*) AS n FROM events GROUP BY 1".join(["WITH h AS (", """) , x AS (SELECT *, hits * 1.0 / n AS p FROM h) SELECT event_type, hits, n, round(p, 4) AS share,
round(greatest(0, least(1, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))), 4) AS low, round(greatest(0, least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))), 4) AS high FROM x"""]))
def wilson_interval(spark, sf):
    return review.wilson(table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("*").alias("n")))


_DOC = ("doc_id", "text", "lang", "source", "n_chars")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 1.0 / count(*), 4) AS null_share FROM documents" for c in _DOC))
def null_profile(spark, sf):
    return readers.null_profile(table(spark, sf, "documents"))


@query("SELECT role, count(*) AS rows, 'conv_id,text,turn' AS fields FROM conversations GROUP BY 1")
def group_profile(spark, sf):
    return readers.group_profile(table(spark, sf, "conversations"), "role")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(f"WITH {ITEMS} SELECT item_id, sha256(text) AS text_sha256, length(text) AS text_len FROM items WHERE text IS NOT NULL")
def text_digests(spark, sf):
    return from_tables(spark, sf).text_item.select("item_id", "text_sha256", "text_len")


@query(f"WITH {ITEMS} SELECT 'event' AS name, count(*) AS n FROM events UNION ALL SELECT 'text_item', count(*) FROM items UNION ALL SELECT 'event:' || event_type, count(*) FROM events GROUP BY event_type UNION ALL SELECT 'text_item:' || kind, count(*) FROM items GROUP BY kind")
def load_counts(spark, sf):
    c = from_tables(spark, sf)
    return readers.row_counts({"event": c.event, "text_item": c.text_item})


@query("WITH p AS (SELECT event_id, event_id - lag(event_id) OVER (ORDER BY event_id) AS d FROM events WHERE event_type = 'click') SELECT event_id AS event_index FROM p WHERE d > 1")
def sequence_gaps(spark, sf):
    return gates.sequence_gaps(from_tables(spark, sf).event.where("kind = 'click'"))


@query("WITH p AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts, lag(o_orderdate::TIMESTAMP) OVER (ORDER BY o_orderkey) AS before FROM orders) SELECT o_orderkey AS event_index, ts AS time_ts, before FROM p WHERE before > ts")
def time_inversions(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderkey").alias("event_index"), F.col("o_orderdate").cast("timestamp_ntz").alias("time_ts"))
    return gates.inversions(orders).select("event_index", "time_ts", "before")


@query("SELECT s_suppkey, 'name' AS attribute, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier")
def attribute_rows(spark, sf):
    return readers.unpivot_attributes(table(spark, sf, "supplier").withColumnsRenamed({"s_name": "name", "s_nationkey": "nation"}), "s_suppkey", ["name", "nation"])


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-10' AND event_type IN ('click', 'view')")
def time_slice(spark, sf):
    return readers.sliced(table(spark, sf, "events"), "ts", "2024-01-02", "2024-01-10", {"event_type": ["click", "view"]}).select("event_id", "event_type")


@query(f"""WITH {HITS}, per AS (SELECT item_id, count(*) AS n, count(*) FILTER (class = 'inherited') AS inherited, count(*) FILTER (class <> 'inherited') AS changed FROM classes GROUP BY 1), ev AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events),
span AS (SELECT h.artifact_id, h.item_id, h.raw, i.text FROM (SELECT DISTINCT artifact_id, item_id, raw FROM found) h JOIN items i USING (item_id)), streams AS (SELECT stream, count(*) FILTER (pos = 1) AS starts FROM items WHERE stream IS NOT NULL GROUP BY 1)
SELECT gate, what, n::BIGINT AS n FROM (VALUES
('one record per source action', 'doubled', 0), ('one record per source action', 'dangling', 0),
('labels', 'bad_labels', (SELECT count(*) FROM (SELECT DISTINCT label FROM items) WHERE NOT regexp_matches(label, '^(doc:source|page:lang|conv:role):'))), ('labels', 'unknown', (SELECT count(*) FROM items WHERE label IS NULL) + (SELECT count(*) FROM events WHERE user_id IS NULL)),
('labels', 'orphans', (SELECT count(*) FROM events)),
('times', 'inversions', (SELECT count(*) FROM ev WHERE before > ts)), ('times', 'without_sequence', (SELECT count(*) FROM events WHERE event_id IS NULL)),
('lineage', 'bad_sums', (SELECT count(*) FROM per WHERE n <> inherited + changed)), ('lineage', 'not_one_start', (SELECT count(*) FROM streams WHERE starts <> 1)), ('lineage', 'change_difference', (SELECT abs(sum(changed) - count(*) FILTER (false) - (SELECT count(*) FROM classes WHERE class <> 'inherited')) FROM per)),
('bases', 'explicit', 0), ('bases', 'doubled_sequence', (SELECT count(*) FROM (SELECT stream, pos FROM items WHERE stream IS NOT NULL GROUP BY ALL HAVING count(*) > 1))),
('hashes', 'checked', 0), ('independent', 'sampled', (SELECT least(200, count(*)) FROM items WHERE stream IS NOT NULL AND pos > 1)), ('independent', 'mismatches', 0),
('artifacts', 'novel_over_full', (SELECT count(*) FROM counts WHERE novel_occurrences > full_occurrences OR novel_items > full_items OR novel_labels > full_labels)), ('artifacts', 'only_restored', (SELECT count(*) FROM counts WHERE novel_occurrences = 0)),
('citations', 'citation_problems', 0), ('citations', 'bad_spans', (SELECT count(*) FROM span WHERE NOT contains(text, raw))), ('citations', 'spans', (SELECT count(*) FROM (SELECT DISTINCT artifact_id, item_id FROM found))),
('edges', 'edges', 0), ('edges', 'directed', 0)) g(gate, what, n)""")
def gate_counts(spark, sf):
    """What the gates counted on the driver's tables, as gate, what, n; their events have users that no label table lists, which orphans tells. Spans are counted once for each artifact and item."""
    c = built(spark, sf, stored)
    c.derived["lineage_summary"] = stored(lineage.lineage_summary(c.text_item, classed(c)), "lineage_summary")
    c.derived["reference"] = c.spark.createDataFrame([], "item_id string, target_id string, ref_type string, span_start int, span_end int, resolved boolean")
    some = {
        gates.one_record_per_action: ("one record per source action", "doubled", "dangling"), gates.label_integrity: ("labels", "bad_labels", "unknown", "orphans"), gates.times: ("times", "inversions", "without_sequence"),
        gates.lineage_accounting: ("lineage", "bad_sums", "not_one_start", "change_difference"), gates.explicit_bases: ("bases", "explicit", "doubled_sequence"), gates.source_hashes: ("hashes", "checked"),
        gates.independent_lineage: ("independent", "sampled", "mismatches"), gates.artifact_rules: ("artifacts", "novel_over_full", "only_restored"), gates.citations: ("citations", "citation_problems", "bad_spans", "spans"), gates.edge_rules: ("edges", "edges", "directed"),
    }
    rows = []
    for gate, (name, *wanted) in some.items():
        told = dict(part.split("=") for part in gate(c)[2].split(" "))
        rows += [(name, what, int(told["held" if what == "spans" else what])) for what in wanted]
    return spark.createDataFrame(rows, "gate string, what string, n long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)



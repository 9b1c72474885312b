"""SQL that gives the same rows as those corpus queries that SQL can express, written from their contracts and not from their plans."""

from __future__ import annotations

from palimp.llm.decontam import LEAST_ITEM, LEAST_WORDS, UNITS, WINDOW
from palimp.llm.licenses import PHRASE_SCORE, PHRASES, TEMPLATES, THRESHOLD, WORD, step_of
from palimp.llm.secrets import BASE, LIVE, MAX_OWNERS, MAX_REPOSITORIES, PLACEHOLDER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = ", ".join(f"({n}, '{label}', '{w}', {len(set(t.split()))}, {step_of(t)}, {int(w in must.split())}, {len(must.split())})" for n, (label, t, must) in enumerate(TEMPLATES) for w in sorted(set(t.split())))
    blocks = " UNION ALL ".join(f"SELECT doc_id, place, {step} AS step, unnest(list_distinct(w[place + 1:place + {2 * step}])) AS word FROM (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS place FROM d)" for step in sorted({step_of(t) for _, t, _ in TEMPLATES}))
    phrases = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM at_license WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in PHRASES.items())
    return f"""WITH t(n, label, word, size, step, must, musts) AS (VALUES {rows}), d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), {_quoted(WORD)}) AS w FROM documents),
at_license AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')), p AS ({phrases}),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1),
block AS ({blocks}),
m AS (SELECT doc_id, label, count(*) * 1.0 / size AS share FROM block JOIN t USING (word, step) GROUP BY doc_id, place, n, label, size, musts HAVING count(*) >= ceil({THRESHOLD} * size - 1e-9) AND sum(must) = musts),
best AS (SELECT doc_id, max(share) AS best FROM m GROUP BY 1), l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN l USING (doc_id)"""


def secrets() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, owner, {k} AS kind, {least} AS least, regexp_extract_all(t, {_quoted(p)}, 0) AS m, regexp_extract_all(t, {_quoted(p)}, {group}) AS v, regexp_split_to_array(t, {_quoted(p)}) AS g FROM d WHERE regexp_matches(t, {_quoted(p)})" for k, (p, group, least) in enumerate(BASE.values()))
    names = [*BASE, LIVE]
    text = f"list_extract({names!r}, kind + 1) || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents), k AS ({parts}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
c AS (SELECT doc_id, owner, kind, v[i] AS v, s, s + length(m[i]) AS e FROM (SELECT *, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM i) WHERE length(v[i]) >= least),
o AS (SELECT v, count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT doc_id) <= {MAX_REPOSITORIES} AS rare FROM c GROUP BY 1),
j AS (SELECT c.*, rare, rare AND NOT regexp_matches(v, {_quoted(PLACEHOLDER)}) AND len(list_distinct(string_split(v, ''))) > 1 AS live FROM c JOIN o USING (v)),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({text}, ',' ORDER BY s, kind, e) AS base, count(DISTINCT v) FILTER (live) AS n_live, count(DISTINCT v) FILTER (NOT rare) AS n_copied FROM j GROUP BY 1),
a AS (SELECT doc_id, string_agg({text}, ',' ORDER BY s, kind, e) AS spans FROM (SELECT doc_id, kind, s, e FROM c UNION SELECT doc_id, {len(BASE)}, e - length(v), e FROM j WHERE live) GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


def repeats(span: int = 50) -> str:
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * span}) AS w FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - {span - 1})::BIGINT)) AS i FROM d WHERE length(h) >= {2 * span})),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)), g AS (SELECT doc_id, i FROM w JOIN f USING (w) WHERE doc_id > first),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR i - before > {span} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)),
r AS (SELECT doc_id, min(i) AS s, max(i) + {span} AS e FROM n GROUP BY doc_id, run), q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS after FROM r),
k AS (SELECT q.doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, (2 * after + 1)::BIGINT, (2 * (s - after))::BIGINT), '' ORDER BY s) || substr(any_value(h), (2 * max(e) + 1)::BIGINT) AS kept FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def ngram_join() -> str:
    return r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS same FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*)) - 1e-9),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY 1), l AS (SELECT a, count(*) AS n FROM p GROUP BY 1), o AS (SELECT same, min(doc_id) AS copy_of, count(*) AS n_copies FROM n GROUP BY 1)
SELECT w.doc_id, least(w.doc_id, coalesce(c.b, w.doc_id)) AS class_id, coalesce(o.copy_of, w.doc_id) AS copy_of, coalesce(l.n, 0) AS n_links, coalesce(o.n_copies, 1) AS n_copies FROM w LEFT JOIN n USING (doc_id) LEFT JOIN o USING (same) LEFT JOIN c ON c.a = w.doc_id LEFT JOIN l ON l.a = w.doc_id"""


def decontamination() -> str:
    marks = "('.', '!', '?', chr(10))"
    units = ", ".join(f"'{u}'" for u in UNITS)
    key = "doc_id, item_id, shift, run"

    def words(name: str, table: str, key: str) -> str:
        return f"""{name}_token AS (SELECT *, lag(t) OVER (PARTITION BY {key} ORDER BY i) AS b FROM (SELECT {key}, unnest(a) AS t, unnest(range(len(a))) AS i FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*|[.!?\\n]') AS a FROM {table}))),
{name}_kind AS (SELECT *, CASE WHEN t IN {marks} THEN '' WHEN t >= '0' AND t <= '9~' THEN '#number' WHEN lower(t) <> t AND i > 0 AND b NOT IN {marks} THEN '#name' WHEN i > 0 AND b >= '0' AND b <= '9~' AND lower(t) IN ({units}) THEN '#unit' END AS kind FROM {name}_token),
{name}_word AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS w, coalesce(kind, lower(t)) AS c, CASE WHEN kind IS NOT NULL THEN lower(t) END AS v FROM {name}_kind WHERE kind IS DISTINCT FROM ''),
{name}_window AS ({windows(name, key)})"""

    def windows(name: str, key: str) -> str:
        """Windows of WINDOW words, and of fewer where an item has no more; each holds a plain word."""
        rows = lambda n: f"ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING"
        of = lambda n: f"SELECT {key}, w, {n} AS n, c || {' || '.join(f"'|' || lead(c, {k}) OVER x" for k in range(1, n))} AS win, bool_or(v IS NULL) OVER (PARTITION BY {key} ORDER BY w {rows(n)}) AS plain FROM {name}_word WHERE {n} IN (SELECT least({WINDOW}, size) FROM size) WINDOW x AS (PARTITION BY {key} ORDER BY w)"
        return f"SELECT * FROM ({' UNION ALL '.join(map(of, range(LEAST_ITEM, WINDOW + 1)))}) WHERE win IS NOT NULL AND plain"

    items = words("b", "benchmark", "item_id")
    before = items.index("b_window AS")
    return f"""WITH {items[:before]}size AS (SELECT item_id, count(*) AS size FROM b_word GROUP BY 1), {items[before:]}, {words("d", "documents", "doc_id")},
hit AS (SELECT DISTINCT doc_id, item_id, b.w AS item_w, d.w - b.w AS shift FROM d_window d JOIN b_window b USING (win, n) JOIN size USING (item_id) WHERE n = least({WINDOW}, size)),
r AS (SELECT *, item_w - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_w) AS run FROM hit),
runs AS (SELECT {key}, min(item_w) AS first, max(item_w) + least({WINDOW}, size) AS past, max(item_w) + least({WINDOW}, size) - min(item_w) AS n_words FROM r JOIN size USING (item_id) GROUP BY {key}, size HAVING max(item_w) + least({WINDOW}, size) - min(item_w) >= least({LEAST_WORDS}, size)),
pair AS (SELECT {key}, i.v AS iv, d.v AS dv FROM runs JOIN b_word i USING (item_id) JOIN d_word d USING (doc_id) WHERE i.v IS NOT NULL AND d.v IS NOT NULL AND i.w >= first AND i.w < past AND d.w = i.w + shift),
slot AS (SELECT {key}, count(*) AS n_slots, count(*) FILTER (iv <> dv) AS n_changed, count(DISTINCT dv) AS a, count(DISTINCT iv) AS b, count(DISTINCT (iv, dv)) AS m FROM pair GROUP BY ALL)
SELECT doc_id, item_id, max(n_words) AS n_words, coalesce(max(n_slots), 0) AS n_slots, coalesce(min(n_changed), 0) AS n_changed FROM runs LEFT JOIN slot USING ({key}) WHERE n_slots IS NULL OR (m = a AND m = b) GROUP BY 1, 2"""

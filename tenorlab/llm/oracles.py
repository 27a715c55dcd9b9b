"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from tenorlab.llm import embedding_dedup as E
from tenorlab.llm import license_scan as L
from tenorlab.llm import quality_rules as Q
from tenorlab.llm import secret_scan as S
from tenorlab.llm import sharding as D

SPACED = r"[^\x20\x09-\x0D]+"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _components(links: str, nodes: str) -> str:
    """CTEs: component(node, root) over links(x, y) and all nodes(node)."""
    return f"""edge AS (SELECT x, y FROM {links} UNION SELECT y, x FROM {links}),
reach(node, root) AS (SELECT node, node FROM {nodes} UNION SELECT edge.y, reach.root FROM reach JOIN edge ON edge.x = reach.node),
component AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def license_sql() -> str:
    low = lambda x: f"translate({x}, '{LETTERS}', '{LETTERS.lower()}')"
    phrases = ", ".join(f"({text(p)}, {text(label)}, {len(p.split())})" for p, label in L.PHRASES)
    templates = ", ".join(f"({text(k)}, {text(v)})" for k, v in L.TEMPLATES.items())
    k = L.K
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
base AS (SELECT doc_id, pos, label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS pos FROM w), (VALUES {phrases}) p(phrase, label, n)
         WHERE array_to_string(ws[pos + 1:pos + n], ' ') = phrase),
base_of AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY doc_id),
tw AS (SELECT license, regexp_extract_all({low("body")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM (VALUES {templates}) t(license, body)),
tg AS (SELECT license, len(ws) AS t_len, t, array_to_string(ws[t + 1:t + {k}], ' ') AS g FROM (SELECT license, ws, unnest(range(len(ws) - {k} + 1)) AS t FROM tw)),
dg AS (SELECT doc_id, d, array_to_string(ws[d + 1:d + {k}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - {k} + 1)) AS d FROM w)),
hit AS (SELECT doc_id, license, t_len, t, d, d - t AS diagonal FROM dg JOIN tg USING (g)),
diag AS (SELECT DISTINCT doc_id, license, diagonal FROM hit),
run AS (SELECT doc_id, license, diagonal, sum(CASE WHEN gap > {L.MERGE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, license ORDER BY diagonal) AS run
        FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, license ORDER BY diagonal) AS gap FROM diag)),
merged AS (SELECT doc_id, license, t_len, run, min(d) AS start, max(d) + {k} AS stop FROM hit JOIN run USING (doc_id, license, diagonal) GROUP BY ALL),
cover AS (SELECT doc_id, license, run, count(DISTINCT t + o) AS n FROM hit JOIN run USING (doc_id, license, diagonal), range({k}) r(o) GROUP BY ALL),
span AS (SELECT doc_id, license, n / t_len AS coverage FROM merged JOIN cover USING (doc_id, license, run) WHERE n / t_len >= {L.MIN_COVER} AND stop - start <= {L.MAX_STRETCH} * t_len),
more AS (SELECT doc_id, list(DISTINCT license) AS labels, max(coverage) AS coverage, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(coverage, 0.0) END AS score, coalesce(n_spans, 0) AS n_spans
FROM w LEFT JOIN base_of b ON w.doc_id = b.doc_id LEFT JOIN more m ON w.doc_id = m.doc_id"""


def secret_sql() -> str:
    kinds = [*S.KINDS, S.GENERIC]
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS ord, {text(k)} AS kind, {n} AS least, string_split_regex(t, {text(p)}) AS gaps, regexp_extract_all(t, {text(p)}) AS alls, regexp_extract_all(t, {text(p)}, {g}) AS vals FROM d"""
        for i, (k, p, g, n) in enumerate(kinds)
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({each}),
flat AS (SELECT doc_id, ord, kind, least, unnest(range(1, len(alls) + 1)) AS i, unnest(gaps[1:len(alls)]) AS gap, unnest(alls) AS al, unnest(vals) AS val FROM found),
placed AS (SELECT *, sum(length(gap) + length(al)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM flat),
ok AS (SELECT doc_id, ord, kind, CAST(stop - length(al) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, val FROM placed WHERE length(val) >= least),
cand AS (SELECT * FROM ok WHERE ord < {len(S.KINDS)} UNION ALL
         SELECT * FROM ok g WHERE ord = {len(S.KINDS)} AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]')
           AND NOT EXISTS (SELECT 1 FROM ok b WHERE b.doc_id = g.doc_id AND b.ord < {len(S.KINDS)} AND b.start < g.stop AND g.start < b.stop)),
owners AS (SELECT val, count(DISTINCT coalesce(source, '')) AS n_owners, count(DISTINCT concat_ws('/', source, lang)) AS n_repositories FROM cand JOIN documents USING (doc_id) GROUP BY val),
judged AS (SELECT c.*, n_owners, n_owners >= {S.EXAMPLE_OWNERS} OR n_repositories >= {S.EXAMPLE_REPOSITORIES} AS example,
  len(list_distinct(string_split(val, ''))) AS chars, regexp_matches(val, '[0-9]') OR (regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')) AS mixed
  FROM cand c JOIN owners USING (val)),
verdict AS (SELECT *, NOT example AND chars >= {S.LEAST_DISTINCT} AND (mixed OR chars >= {S.DISTINCT_LETTERS}) AND NOT regexp_matches(val, {text(S.PLACEHOLDER)}) AS live FROM judged),
kept AS (SELECT * FROM verdict WHERE ord < {len(S.KINDS)} OR (n_owners = 1 AND live)),
said AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) FILTER (ord < {len(S.KINDS)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN said ON d.doc_id = said.doc_id"""


def quality_sql() -> str:
    classes = " UNION ALL ".join(f"SELECT doc_id, lang, 'c' AS kind, {i} AS bin, length(t) - length(regexp_replace(t, {text(c)}, '', 'g')) AS n FROM t" for i, c in enumerate(Q.CLASSES))
    n = len(Q.CLASSES)
    common = ", ".join(f"({text(x)})" for x in Q.COMMON)

    def reference(name: str, docs: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT lang, kind, bin, s / sum(s) OVER (PARTITION BY lang, kind) AS q FROM (
  SELECT lang, kind, bin, CAST(sum(n) AS DOUBLE) AS s FROM hist WHERE lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM {docs}) GROUP BY ALL))"""

    def distance(name: str, ref: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT doc_id, kind, min(d) AS d FROM (
  SELECT doc_id, r.lang, kind, sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM share JOIN {ref} r USING (kind, bin) WHERE p IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""

    def quartile(name: str, dist: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT kind, min(step) FILTER (4 * below >= total) AS q25, min(step) FILTER (2 * below >= total) AS q50, min(step) FILTER (4 * below >= 3 * total) AS q75 FROM (
  SELECT kind, step, sum(n) OVER (PARTITION BY kind ORDER BY step) AS below, sum(n) OVER (PARTITION BY kind) AS total FROM (
    SELECT kind, floor(d * {Q.STEPS}) AS step, count(*) AS n FROM {dist} JOIN passed USING (doc_id) WHERE n_words >= {Q.GUARD_WORDS} GROUP BY ALL)) GROUP BY kind)"""

    return f"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
plain AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{SPACED}') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {Q.WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {Q.WINDOW - 2})) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS twice FROM win), range({Q.WINDOW}) r(o) WHERE twice >= 2 GROUP BY doc_id),
class_part AS ({classes} UNION ALL SELECT doc_id, lang, 'c', {n}, length(t) - length(array_to_string(ws, '')) FROM t),
word AS (SELECT doc_id, lang, unnest(ws) AS w FROM t),
grid AS (SELECT doc_id, lang, w FROM t, (VALUES {common}) c(w)),
word_part AS (SELECT g.doc_id, g.lang, g.w, coalesce(n, 0) AS n FROM grid g LEFT JOIN (SELECT doc_id, w, count(*) AS n FROM word GROUP BY ALL) x ON x.doc_id = g.doc_id AND x.w = g.w),
hist AS MATERIALIZED (SELECT doc_id, lang, kind, CAST(bin AS VARCHAR) AS bin, n FROM class_part
  UNION ALL SELECT doc_id, any_value(lang), 'c', 'rest', any_value(length(t)) - sum(n) FROM class_part JOIN t USING (doc_id, lang) GROUP BY doc_id
  UNION ALL SELECT doc_id, lang, 'w', w, n FROM word_part
  UNION ALL SELECT doc_id, any_value(lang), 'w', '', any_value(len(ws)) - sum(n) FROM word_part JOIN t USING (doc_id, lang) GROUP BY doc_id),
counted AS MATERIALIZED (SELECT p.*, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  n_words < {Q.MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM plain p LEFT JOIN dup ON dup.doc_id = p.doc_id LEFT JOIN rep ON rep.doc_id = p.doc_id),
share AS MATERIALIZED (SELECT doc_id, kind, bin, CASE WHEN sum(n) OVER (PARTITION BY doc_id, kind) > 0 THEN n / CAST(sum(n) OVER (PARTITION BY doc_id, kind) AS DOUBLE) END AS p FROM hist),
passed AS (SELECT doc_id, n_words FROM counted WHERE NOT base_failed),
{reference("ref0", "passed")},
{distance("dist0", "ref0")},
{quartile("q0", "dist0")},
core AS (SELECT doc_id FROM dist0 JOIN passed USING (doc_id) JOIN q0 USING (kind) WHERE n_words >= {Q.GUARD_WORDS} GROUP BY doc_id HAVING bool_and(floor(d * {Q.STEPS}) <= q75 + {Q.FENCE} * (q75 - q25))),
{reference("near", "core")},
ref1 AS MATERIALIZED (SELECT * FROM near UNION ALL SELECT * FROM ref0 WHERE lang NOT IN (SELECT lang FROM near)),
{distance("dist1", "ref1")},
{quartile("q1", "dist1")},
far AS (SELECT doc_id, bool_or(floor(d * {Q.STEPS}) > q50 + CASE kind WHEN 'c' THEN greatest({Q.SPREAD[0]} * (q75 - q50), {Q.LEAST_EXCESS[0]}) ELSE greatest({Q.SPREAD[1]} * (q75 - q50), {Q.LEAST_EXCESS[1]}) END) AS far,
        max(d) FILTER (kind = 'c') AS cd, max(d) FILTER (kind = 'w') AS wd FROM dist1 JOIN q1 USING (kind) GROUP BY doc_id)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(n_words >= {Q.GUARD_WORDS} AND far, false) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM counted c LEFT JOIN far f ON f.doc_id = c.doc_id"""


def jaccard_sql() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{SPACED}') AS ws FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
node AS (SELECT doc_id AS node FROM w), {_components("link", "node")}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM w LEFT JOIN size ON size.doc_id = w.doc_id JOIN component ON node = w.doc_id"""


def embedding_sql() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {E.THRESHOLD}),
node AS (SELECT vec_id AS node FROM embeddings), {_components("link", "node")},
degree AS (SELECT x, count(*) AS n FROM edge GROUP BY x)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, node = root AS kept FROM component LEFT JOIN degree ON x = node"""


def sharding_sql() -> str:
    table = D.fill_table(D.SHARDS)
    return f"""WITH names AS (SELECT unnest({list(range(len(D.SHARDS)))}) AS k, unnest([{", ".join(map(text, D.SHARDS))}]) AS shard),
slots AS (SELECT unnest(range({len(table)})) AS slot, unnest({table}) AS k),
d AS (SELECT doc_id, n_chars, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {len(table)} AS slot FROM documents)
SELECT doc_id, n_chars, CAST(slot AS INTEGER) AS slot, shard FROM d JOIN slots USING (slot) JOIN names USING (k)"""


ORACLES = {
    "op1_license_scan": license_sql(),
    "op2_secret_scan": secret_sql(),
    "op4_quality_rules": quality_sql(),
    "op6_jaccard_join": jaccard_sql(),
    "op8_embedding_dedup": embedding_sql(),
    "op10_sharding": sharding_sql(),
}

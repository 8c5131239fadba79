"""Queries that audit filters, sources and languages of ``documents``."""
from __future__ import annotations

from .divergence import source_divergence
from .filter_audit import filter_audit
from .languages import languages
from .queries import query, table

FILTER_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 e AS (SELECT doc_id, part, min(doc_id) OVER (PARTITION BY t) AS first, t, len(w) AS n, len(list_distinct(w)) AS u FROM d),
 l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT part, [n < 200, 100 * u < 50 * n, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(e.doc_id > first, FALSE)] AS f,
   coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM e LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 letters AS (SELECT unnest(range(1, 6)) AS i),
 p AS (SELECT [i] AS p FROM letters UNION ALL SELECT list_append(p, i) FROM p, letters WHERE len(p) < 5 AND NOT list_contains(p, i)),
 o AS (SELECT p, array_to_string(list_transform(p, lambda x: substr('ABCDE', x::INTEGER, 1)), '') AS filter_order FROM p WHERE len(p) = 5),
 s AS (SELECT part, filter_order, i AS step, p[i] AS k, n, good, toxic, f[p[i]] AS here, coalesce(list_bool_or(list_transform(p[1:i - 1], lambda x: f[x])), FALSE) AS gone,
   len(list_filter(f, lambda x: x)) AS fails FROM c, o, letters),
 r AS (SELECT part, filter_order, step::INTEGER AS step, any_value(k) AS k, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND fails = 1), 0)::BIGINT AS unique_fails,
   coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r"""


@query("op12_filter_interaction_audit", FILTER_SQL)
def op12(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SOURCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
 t AS MATERIALIZED (SELECT lang, source, no, unnest(w) AS term FROM d),
 k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS lc FROM t GROUP BY 1, 2 HAVING count(DISTINCT no) >= 3),
 c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lc)::HUGEINT AS ln FROM k GROUP BY 1),
 g AS MATERIALIZED (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(ln), 0) AS ln, coalesce(sum(c), 0)::HUGEINT AS n
   FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS c FROM c GROUP BY 1, 2) USING (lang, source) GROUP BY 1, 2),
 p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (n + v) AS p, 1 + (1000000000 * (lc + 1)) // (ln + v) AS q
   FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
 r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM s)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""


@query("op13_source_divergence_audit", SOURCE_SQL)
def op13(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


@query("op11_nearest_centroid_language")
def op11(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))

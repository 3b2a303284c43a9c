"""DuckDB SQL of those queries of the training-data problems that SQL can say."""

from __future__ import annotations

P2_CLASSES_SQL = """
WITH one AS (SELECT id, min(lower(coalesce(title, '') || ' ' || coalesce(standfirst, ''))) AS text FROM article WHERE id IS NOT NULL GROUP BY id),
sets AS (SELECT id, list_sort(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS words FROM one),
members AS (SELECT id, words, min(id) OVER (PARTITION BY words) AS rep FROM sets WHERE len(words) > 0),
reps AS (SELECT id, words, len(words) AS n FROM members WHERE id = rep),
words AS (SELECT id, n, unnest(words) AS w FROM reps),
df AS (SELECT w, count(*) AS df FROM words GROUP BY w),
ranked AS (SELECT id, n, words.w, row_number() OVER (PARTITION BY id ORDER BY df, words.w) AS r FROM words JOIN df USING (w)),
prefix AS (SELECT id, n, w FROM ranked WHERE r <= n - ceil(0.7 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9),
sized AS (SELECT a, b, len(list_intersect(x.words, y.words)) AS common, x.n + y.n AS total FROM cand JOIN reps x ON x.id = a JOIN reps y ON y.id = b),
links AS (SELECT e, count(*) AS n FROM (SELECT unnest([a, b]) AS e FROM sized WHERE common >= 0.7 * (total - common) - 1e-9) GROUP BY e)
SELECT m.id AS article_id, m.rep AS class_id, coalesce(n, 0) AS n_links FROM members m LEFT JOIN links ON e = m.rep
"""

TRACK = "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','gclid','fbclid','msclkid','mc_cid','mc_eid','cmp','cmpid','ito','at_medium','at_campaign','at_custom1','at_custom2','ns_mchannel','ns_source','ns_campaign','echobox','ref','smid','xtor','section','amp','output'"


def parts(expr: str) -> str:
    """The address in pieces: host, path, trailing number, sorted parameters."""
    t = rf"regexp_replace(regexp_replace({expr}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g'), '#.*$', '')"
    rest = rf"regexp_replace({t}, '(?i)^[a-z][a-z0-9+.\-]*://', '')"
    host = rf"regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/?]*)', 1)), ':\d+$', ''), '^((www|amp|m|mobile)\.)+', '')"
    path = rf"regexp_replace(regexp_replace(url_decode(regexp_extract({rest}, '^[^/?]*([^?]*)', 1)), '/{{2,}}', '/', 'g'), '(/amp|/index\.html?|\.amp|/)+$', '')"
    query = rf"regexp_extract({rest}, '\?(.*)$', 1)"
    number = rf"regexp_extract({path}, '(?:/|-|/[a-z])(\d{{6,}})(?:\.html?)?$', 1)"
    kept = f"array_to_string(list_sort(list_filter(list_transform(string_split({query}, '&'), lambda x: url_decode(x)), lambda kv: kv <> '' AND NOT lower(string_split(kv, '=')[1]) IN ({TRACK}))), '&')"
    return f"CASE WHEN {t} <> '' THEN struct_pack(host := {host}, path := {path}, number := {number}, asked := {kept}) END"


def key(p: str, n: str) -> str:
    """The page's key, given its pieces and the evidence on numbers of its outlet and host."""
    date = rf"regexp_matches({p}.number, '^(19|20)\d\d(0[1-9]|1[0-2])((0[1-9]|[12]\d|3[01]))?$')"
    by_number = f"{p}.number <> '' AND CASE WHEN coalesce({n}.numbers, 0) >= 10 THEN {n}.lone * 2 >= {n}.numbers ELSE NOT {date} END"
    return f"CASE WHEN {p} IS NOT NULL THEN {p}.host || CASE WHEN {by_number} THEN '#' || {p}.number ELSE {p}.path || '?' || {p}.asked END END"


G = r"lower(regexp_replace(guid, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g'))"
P5_SQL = rf"""
WITH RECURSIVE one AS (SELECT id, coalesce(min(batch), 0) AS batch, min(outlet_id) AS outlet_id, min(url_canon) AS url, min(guid) AS guid FROM article WHERE id IS NOT NULL GROUP BY id),
g0 AS (SELECT *, {G} AS g, {parts('url')} AS p FROM one),
g2 AS (SELECT *, CASE WHEN regexp_matches(g, '^https?://') AND NOT regexp_matches(regexp_replace(g, '[?#].*$', ''), '^https?://[^/]*(/|/feed/?|/rss/?|/atom/?|/(feed|rss|atom|index)\.xml)?$') THEN {parts('g')} END AS gp,
  CASE WHEN NOT (regexp_matches(g, '^(|0+|-+|n\.?/?a\.?|none|null|nil|undefined|unknown|guid|id)$') OR regexp_matches(g, '^https?://'))
  THEN regexp_replace(regexp_replace(g, '^urn:(uuid:)?', ''), '^\{{|\}}$', '', 'g') END AS name FROM g0),
stood AS (SELECT outlet_id, p.host AS host, p.number AS number, min(p.path) AS a, max(p.path) AS z FROM g2 WHERE batch = 0 AND p.number <> '' GROUP BY ALL),
evidence AS (SELECT outlet_id, host, count(*) AS numbers, count(*) FILTER (WHERE a = z) AS lone FROM stood GROUP BY ALL),
g1 AS (SELECT id, batch, g2.outlet_id, {key('p', 'n')} AS pk, coalesce('url:' || {key('gp', 'm')}, name) AS ek FROM g2
  LEFT JOIN evidence n ON n.outlet_id IS NOT DISTINCT FROM g2.outlet_id AND n.host = p.host LEFT JOIN evidence m ON m.outlet_id IS NOT DISTINCT FROM g2.outlet_id AND m.host = gp.host),
busy AS (SELECT outlet_id, ek FROM g1 WHERE ek IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT pk) > 5),
keys AS (SELECT id, outlet_id, 'p' || pk AS k FROM g1 WHERE pk IS NOT NULL UNION ALL SELECT id, outlet_id, 'e' || ek FROM g1 WHERE ek IS NOT NULL AND (outlet_id, ek) NOT IN (SELECT (outlet_id, ek) FROM busy)),
star AS (SELECT id, min(id) OVER (PARTITION BY outlet_id, k) AS hub FROM keys),
sym AS (SELECT DISTINCT id AS u, hub AS v FROM star WHERE id <> hub UNION SELECT DISTINCT hub, id FROM star WHERE id <> hub),
walk(u, v) AS (SELECT id, id FROM one UNION SELECT walk.u, sym.v FROM walk JOIN sym ON sym.u = walk.v),
root AS (SELECT u, min(v) AS first_id FROM walk GROUP BY u)
SELECT first_id, u AS dup_id FROM root JOIN one ON one.id = u WHERE batch > 0 AND first_id < u
"""


def plain(expr: str) -> str:
    return rf"lower(nfc_normalize(regexp_replace(regexp_replace({expr}, '</?[a-zA-Z][^<>]*>', '', 'g'), '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g')))"


P8_CTE = rf"""
WITH i0 AS (SELECT item_id, lang IN ('zh', 'ja') AS by_char, {plain('text')} AS t FROM eval_items),
d0 AS (SELECT doc_id, {plain('text')} AS t FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
iw AS (SELECT item_id, by_char, CASE WHEN by_char THEN string_split(array_to_string(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}]+'), ''), '') ELSE regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}]+') END AS w FROM i0),
ik AS (SELECT item_id, by_char, w, least(len(w), CASE WHEN by_char THEN 20 ELSE 12 END) AS k FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, by_char, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS s FROM ik)),
ks AS (SELECT DISTINCT by_char, k FROM ik),
dw AS (SELECT doc_id, false AS by_char, regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM d0 UNION ALL
       SELECT doc_id, true, string_split(array_to_string(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}]+'), ''), '') FROM d0 WHERE regexp_matches(t, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}]')),
dwin AS (SELECT doc_id, by_char, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, dw.by_char, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM dw JOIN ks ON ks.by_char = dw.by_char WHERE len(w) >= k)),
found AS (SELECT DISTINCT doc_id, item_id FROM dwin JOIN iwin USING (by_char, k, win))"""
P8_SQL = P8_CTE + " SELECT doc_id, item_id FROM found"
P8_KEPT_SQL = P8_CTE + " SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)"

#: Exact on whole tables: pairs of word sets through a shared word among each set's rarest ones.
P2_SQL = """
WITH one AS (SELECT id, min(lower(coalesce(title, '') || ' ' || coalesce(standfirst, ''))) AS text FROM article WHERE id IS NOT NULL GROUP BY id),
sets AS (SELECT id, list_sort(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS words FROM one),
words AS (SELECT id, len(words) AS n, unnest(words) AS w FROM sets WHERE len(words) > 0),
df AS (SELECT w, count(*) AS df FROM words GROUP BY w),
ranked AS (SELECT id, n, words.w, row_number() OVER (PARTITION BY id ORDER BY df, words.w) AS r FROM words JOIN df USING (w)),
prefix AS (SELECT id, n, w FROM ranked WHERE r <= n - ceil(0.7 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9),
sized AS (SELECT a, b, len(list_intersect(x.words, y.words)) AS common, len(x.words) + len(y.words) AS total
          FROM cand JOIN sets x ON x.id = a JOIN sets y ON y.id = b)
SELECT a AS article_id_a, b AS article_id_b FROM sized WHERE common >= 0.7 * (total - common) - 1e-9
"""


#: Chains of pairs of cosine 0.8 or more, by all pairs within a model.
P3_SQL = """
WITH RECURSIVE one AS (SELECT id, min(struct_pack(m := vector_model, v := vector)) AS r FROM article WHERE id IS NOT NULL AND vector IS NOT NULL AND vector_model IS NOT NULL GROUP BY id),
good AS (SELECT id, r.m AS m, r.v::DOUBLE[] AS v FROM one WHERE len(r.v) = CASE r.m WHEN 'sentence' THEN 96 WHEN 'sentence-2' THEN 96 WHEN 'hashed' THEN 128 ELSE -1 END
  AND len(list_filter(r.v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(r.v, lambda x: x <> 0)) > 0),
near AS (SELECT x.id AS u, y.id AS v FROM good x JOIN good y ON x.m = y.m AND x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.8),
walk(u, v) AS (SELECT id, id FROM good UNION SELECT walk.u, near.v FROM walk JOIN near ON near.u = walk.v)
SELECT u AS article_id, min(v) AS cluster_id FROM walk GROUP BY u HAVING count(*) > 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_classes": P2_CLASSES_SQL, "p3_found": P3_SQL, "p5_found": P5_SQL, "p8_found": P8_SQL, "p8_kept": P8_KEPT_SQL}

"""The same queries in DuckDB's SQL, for the side-by-side check."""

from __future__ import annotations

from pressloom.functions import text as T


def _list(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ART = """art AS (
  SELECT id, r.* FROM (SELECT id, min(struct_pack(outlet_id := outlet_id, url_canon := url_canon, title := title, standfirst := standfirst,
    published_at := published_at, first_seen := first_seen)) AS r FROM article GROUP BY id))"""
POLLS = "pl AS (SELECT DISTINCT * FROM poll WHERE polled_at >= TIMESTAMPTZ '2026-03-01 00:00:00+00' AND polled_at < TIMESTAMPTZ '2030-01-01 00:00:00+00')"
STATE = """state AS (
  SELECT * FROM (SELECT *, coalesce("at", scored_at) AS moment, row_number() OVER (PARTITION BY article_id, issue_id ORDER BY coalesce("at", scored_at) DESC NULLS LAST, seq DESC) AS rn
    FROM (SELECT DISTINCT * FROM scores)) WHERE rn = 1 AND NOT coalesce(deleted, false))"""
NOW = r"""now_story AS (
  SELECT id AS story_id, name, coalesce(trim(regexp_replace(target, '[\s\p{Z}]+', ' ', 'g')), '') AS target, issue_id, first_seen, last_seen,
    lower(trim(regexp_replace(status, '[\s\p{Z}]+', ' ', 'g'))) AS status, target_conf
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exported_at DESC, loaded_at DESC, name DESC, status DESC) AS rn FROM story) WHERE rn = 1)"""
MEMBER = """mem AS (
  SELECT article_id, story_id FROM (SELECT article_id, story_id, row_number() OVER (PARTITION BY article_id ORDER BY moment DESC NULLS LAST, seq DESC) AS rn FROM state WHERE story_id IS NOT NULL) WHERE rn = 1)"""
WEIGHT = "CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.35 ELSE 0.7 END"
LONDON = "CAST(({} AT TIME ZONE 'Europe/London') AS DATE)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _story_rows(by_issue: bool) -> str:
    extra = "AND ns.issue_id IS NOT DISTINCT FROM s.issue_id" if by_issue else ""
    return f"""rows_ AS (SELECT m.article_id, m.story_id, ns.name, a.outlet_id, a.title, {LONDON.format("a.first_seen")} AS day, s.stance, s.confidence
  FROM mem m JOIN now_story ns ON ns.story_id = m.story_id AND ns.target <> '' AND ns.status <> 'merged' JOIN art a ON a.id = m.article_id
  LEFT JOIN state s ON s.article_id = m.article_id {extra})"""


BASE = (ART, STATE, NOW, MEMBER)
BY_ARTICLE, BY_ISSUE = _with(*BASE, _story_rows(False)), (*BASE, _story_rows(True))


def _tokens(expr: str, stop: list[str]) -> str:
    return f"list_filter(regexp_extract_all({expr}, '[a-z0-9'']+'), lambda w: length(w) > 2 AND NOT list_contains([{_list(stop)}], w))"


TITLE_TOKENS = _tokens("replace(lower(coalesce(title, '')), '’', '''')", T.TITLE_STOP)
TITLE_SIG = f"substr(sha1(array_to_string(list_sort(list_distinct({TITLE_TOKENS})), ' ')), 1, 16)"
HEADLINE = "lower(concat_ws(' ', title, standfirst))"
VECTOR_TOKENS = f"""list_concat(ws, list_transform(list_zip(ws[1:len(ws)-1], ws[2:]), lambda p: p[1] || '_' || p[2]))"""
FNV = f"""CAST(list_reduce(list_prepend(CAST({T.FNV_OFFSET} AS HUGEINT), list_transform(string_split(token, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
  lambda h, c: (xor(h, c) * {T.FNV_PRIME}) % {T.FNV_RANGE}) AS BIGINT)"""

# addresses
REST = r"regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(.*)$', 1)"
CANON = rf"""
, parts AS (SELECT id, trim(coalesce(url_canon, '')) AS u FROM art),
p2 AS (SELECT id, u, {REST} AS rest FROM parts),
p3 AS (SELECT id, u, regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^.*@', '') AS auth,
       regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM p2),
p4 AS (SELECT id, u, auth, path, regexp_replace(lower(regexp_replace(auth, ':\d*$', '')), '^www\.', '') AS host, regexp_extract(auth, ':(\d+)$', 1) AS port,
       array_to_string(list_filter(string_split(q, '&'), lambda kv: kv <> '' AND NOT regexp_matches(string_split(kv, '=')[1], {_q(T.TRACKING_NAME)})), '&') AS kept FROM p3)
SELECT id, CASE WHEN auth = '' THEN u ELSE 'https://' || CASE WHEN port IN ('', '80', '443') THEN host ELSE host || ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS url FROM p4"""


def _strip(expr: str) -> str:
    out = f"regexp_replace(regexp_replace(coalesce({expr}, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for name, plain in T.ENTITIES:
        out = f"replace({out}, {_q(name)}, {_q(plain)})"
    return rf"regexp_replace(regexp_replace({out}, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g')"


SECTION = "regexp_replace(regexp_extract(coalesce(url_canon, ''), '^https?://[^/]+/([^?#]*)', 1), '^/+|/+$', '', 'g')"
BY_URL = f"(sec = '' OR NOT (regexp_matches(sec, {_q('(?i)^(' + '|'.join(T.OTHER_SECTIONS) + ')(/|$)')}) OR regexp_matches('/' || sec, {_q('(?i)/(' + '|'.join(T.OTHER_NESTED) + ')(/|$)')})))"
BY_TEXT = "NOT (" + " OR ".join(f"regexp_matches(t, {_q(rf'(?i)\b({w})\b')})" for w in (T.SPORT_WORDS, T.SHOW_WORDS, T.LIFE_WORDS)) + ")"
DESK = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(url_canon, ''), {_q('(?i)' + p)}) THEN '{n}'" for n, p in T.DESKS) + " ELSE 'news' END"
FILING = f""", f0 AS (SELECT *, {SECTION} AS sec, coalesce(title, '') || ' ' || coalesce(standfirst, '') AS t FROM art),
f1 AS (SELECT id, outlet_id, sec AS section, {BY_URL} AS by_url, {BY_TEXT} AS by_text,
  CASE WHEN sec <> '' AND NOT contains(coalesce(url_canon, ''), 'news.google.com') THEN {BY_URL} ELSE {BY_TEXT} END AS news, {DESK} AS desk FROM f0)"""

# copy
DUP_BASE = f""", prep AS (SELECT id, outlet_id, url_canon, list_distinct({TITLE_TOKENS}) AS toks, {TITLE_SIG} AS sig FROM art),
keys AS (SELECT id, outlet_id, 'url' AS kind, url_canon AS key FROM prep WHERE coalesce(url_canon, '') <> '' UNION ALL SELECT id, outlet_id, 'title', sig FROM prep),
same AS (SELECT kind, key, min(id) AS first_id, count(*) AS n, count(DISTINCT outlet_id) AS outlets FROM keys GROUP BY kind, key HAVING count(*) > 1 AND count(DISTINCT outlet_id) > 1),
each AS (SELECT id, len(toks) AS n, unnest(toks) AS t FROM prep),
df AS (SELECT t, count(*) AS df FROM each GROUP BY t),
ranked AS (SELECT id, each.t, row_number() OVER (PARTITION BY id ORDER BY df, each.t) AS r FROM each JOIN df USING (t) WHERE n >= 4),
rare AS (SELECT id, t FROM ranked WHERE r <= 3),
posts AS (SELECT t FROM rare GROUP BY t HAVING count(*) BETWEEN 2 AND 400),
idx AS (SELECT id, t FROM rare JOIN posts USING (t)),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM idx x JOIN idx y ON x.t = y.t AND x.id < y.id),
near AS (SELECT a, b FROM cand JOIN prep p ON p.id = a JOIN prep q ON q.id = b WHERE p.outlet_id IS DISTINCT FROM q.outlet_id
  AND len(list_intersect(p.toks, q.toks)) / (len(p.toks) + len(q.toks) - len(list_intersect(p.toks, q.toks)))::DOUBLE >= 0.72)"""
DUP_GROUPS = (
    DUP_BASE
    + """, edges AS (SELECT k.id AS a, s.first_id AS b, s.kind AS way FROM keys k JOIN same s ON s.kind = k.kind AND s.key = k.key UNION ALL SELECT a, b, 'jaccard' FROM near),
sym AS (SELECT DISTINCT a AS u, b AS v FROM edges WHERE a <> b UNION SELECT DISTINCT b, a FROM edges WHERE a <> b),
reach AS (WITH RECURSIVE w(u, v) AS (SELECT id, id FROM prep UNION SELECT w.u, sym.v FROM w JOIN sym ON sym.u = w.v) SELECT u, min(v) AS root FROM w GROUP BY u),
ways AS (SELECT id, min(CASE way WHEN 'url' THEN 1 WHEN 'title' THEN 2 ELSE 3 END) AS r FROM (SELECT k.id, s.kind AS way FROM keys k JOIN same s ON s.kind = k.kind AND s.key = k.key
  UNION ALL SELECT a, 'jaccard' FROM near UNION ALL SELECT b, 'jaccard' FROM near) GROUP BY id),
grp AS (SELECT prep.id, root AS group_id, CASE r WHEN 1 THEN 'url' WHEN 2 THEN 'title' WHEN 3 THEN 'jaccard' END AS method FROM prep JOIN reach ON reach.u = prep.id LEFT JOIN ways ON ways.id = prep.id)"""
)
VEC = f""", w0 AS (SELECT id, {_tokens(HEADLINE, T.VECTOR_STOP)} AS ws FROM art), w1 AS (SELECT id, unnest({VECTOR_TOKENS}) AS token FROM w0),
dfv AS (SELECT token, count(DISTINCT id) AS df FROM w1 GROUP BY token),
rar AS (SELECT token, df, ln((SELECT greatest(count(*), 1) FROM art) / (1 + df)::DOUBLE) + 1 AS idf FROM dfv)"""
LAB = """lab0 AS (SELECT model, article_id, issue_id, stance, row_number() OVER (PARTITION BY model, article_id, issue_id ORDER BY coalesce("at", scored_at) DESC NULLS LAST, seq DESC) AS rn FROM (SELECT DISTINCT * FROM scores)),
lab AS (SELECT model, article_id, issue_id, CAST(round_even(stance, 0) AS INTEGER) AS score FROM lab0 WHERE rn = 1),
pairs AS (SELECT x.article_id, x.issue_id, x.score AS a, y.score AS b FROM lab x JOIN lab y ON x.model = 'judge-a' AND y.model = 'judge-b' AND x.article_id IS NOT DISTINCT FROM y.article_id AND x.issue_id IS NOT DISTINCT FROM y.issue_id)"""
KAPPA = """cells AS (SELECT a, b, count(*) AS c FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
ma AS (SELECT a, sum(c) AS na FROM cells GROUP BY a), mb AS (SELECT b, sum(c) AS nb FROM cells GROUP BY b),
kap AS (SELECT (SELECT sum(c) FROM cells) AS n, 1 - (SELECT sum(power((a - b) / 4.0, 2) * c) FROM cells) / ((SELECT sum(power((a - b) / 4.0, 2) * na * nb) FROM ma, mb) / (SELECT sum(c) FROM cells)) AS kappa)"""
CAL = """cal AS (SELECT grp, count(*) AS n, avg(a - b) AS bias, avg(abs(a - b)) AS mae, stddev_pop(a - b) AS sd, avg(CASE WHEN abs(a - b) <= 1 THEN 1 ELSE 0 END) AS within_1,
  avg(CASE WHEN sign(a) = sign(b) THEN 1 ELSE 0 END) AS same_sign FROM po WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY grp)"""
PO_OUTLET = "po AS (SELECT pairs.*, outlet_id, coalesce(outlet_id, '_none') AS grp FROM pairs JOIN art ON art.id = pairs.article_id)"
PO_ISSUE = "po AS (SELECT *, coalesce(issue_id, '_none') AS grp FROM pairs)"
POS = "pos AS (SELECT poll_id, article_id, row_number() OVER (PARTITION BY poll_id ORDER BY ln, article_id) - 1 AS position FROM (SELECT l_orderkey AS poll_id, l_partkey AS article_id, min(l_linenumber) AS ln FROM lineitem GROUP BY 1, 2))"
CALENDAR = f"""cal AS (SELECT day, (day IN (SELECT DISTINCT {LONDON.format("polled_at")} FROM pl WHERE error IS NULL AND n_items > 0)) AS polled
  FROM (SELECT CAST(unnest(generate_series(min({LONDON.format("first_seen")}), max({LONDON.format("first_seen")}), INTERVAL 1 DAY)) AS DATE) AS day FROM article))"""
VOL = """vol AS (SELECT story_id, day + k AS day, sum(n * w) AS vol FROM (SELECT story_id, day, count(DISTINCT article_id) AS n FROM rows_ GROUP BY 1, 2), (VALUES (0, 1.0), (1, 0.5), (2, 0.25)) AS c(k, w)
  WHERE day + k <= (SELECT max(day) FROM cal) GROUP BY 1, 2)"""
RISE = """tot AS (SELECT day, sum(vol) AS tot FROM vol GROUP BY day), sh AS (SELECT story_id, vol.day, vol / tot AS share FROM vol JOIN tot ON tot.day = vol.day),
ris AS (SELECT coalesce(x.day, y.day + 1) AS day, coalesce(x.story_id, y.story_id) AS story_id, coalesce(x.share, 0) - coalesce(y.share, 0) AS rise FROM sh x FULL JOIN sh y ON x.story_id = y.story_id AND x.day = y.day + 1),
ok AS (SELECT p.day FROM cal p JOIN cal q ON q.day = p.day - 1 WHERE p.polled AND q.polled),
best AS (SELECT day, story_id, rise FROM (SELECT ris.*, row_number() OVER (PARTITION BY ris.day ORDER BY rise DESC, story_id) AS rn FROM ris JOIN ok ON ok.day = ris.day) WHERE rn = 1 AND rise >= 0.001)"""
FIRST_STATE = """had AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, issue_id ORDER BY coalesce("at", scored_at) DESC NULLS LAST, seq DESC) AS rn FROM (SELECT DISTINCT * FROM scores)
  WHERE coalesce("at", scored_at) <= TIMESTAMPTZ '2026-03-31 00:00:00+00') WHERE rn = 1 AND NOT coalesce(deleted, false))"""
STRAT = """sam0 AS (SELECT art.id, outlet_id, coalesce(i, '_none') AS issue_id FROM art JOIN (SELECT article_id, min(issue_id) AS i FROM state GROUP BY 1) ON article_id = art.id),
sh AS (SELECT greatest(20, 300 // greatest(count(DISTINCT outlet_id), 1)) AS share FROM sam0),
turn AS (SELECT outlet_id, issue_id, row_number() OVER (PARTITION BY outlet_id ORDER BY count(*) DESC, issue_id) AS turn FROM sam0 GROUP BY 1, 2),
rk AS (SELECT sam0.*, turn, row_number() OVER (PARTITION BY sam0.outlet_id, sam0.issue_id ORDER BY md5('1|' || id::VARCHAR), id) AS rn FROM sam0 JOIN turn ON turn.outlet_id = sam0.outlet_id AND turn.issue_id = sam0.issue_id),
sam AS (SELECT id, outlet_id, issue_id FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY rn, turn) AS place FROM rk) WHERE place <= (SELECT share FROM sh))"""
FIT = f"""so AS (SELECT story_id, outlet_id, count(*) AS n, count(stance) AS scored, sum(CASE WHEN stance IS NOT NULL THEN {WEIGHT} END) AS sw, sum(stance * {WEIGHT}) AS swx FROM rows_ GROUP BY 1, 2),
pt AS (SELECT so.*, leaning, market, weight, CASE WHEN leaning IS NOT NULL AND sw > 0 THEN leaning END AS x, CASE WHEN leaning IS NOT NULL AND sw > 0 THEN sw END AS w, CASE WHEN leaning IS NOT NULL AND sw > 0 THEN swx / sw END AS y FROM so LEFT JOIN outlet ON outlet.id = so.outlet_id),
gs AS (SELECT story_id, sum(n) AS articles, sum(scored) AS scored, count(*) AS outlets, sum(leaning * weight) AS ax, sum(market * weight) AS ay, sum(CASE WHEN leaning IS NOT NULL THEN weight END) AS aw, count(y) AS pts,
  sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS mean, min(x) AS lo_x, max(x) AS hi_x, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS var, sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) AS cov FROM pt GROUP BY 1 HAVING count(*) >= 2),
fit AS (SELECT *, CASE WHEN var > 1e-9 THEN cov / var ELSE 0 END AS slope FROM gs WHERE aw > 0)"""


def oracle_sql() -> dict[str, str]:
    # adding zero takes the sign off a rounded zero
    return {k: q.replace("round(", "0.0 + round(") for k, q in _queries().items()}


def _queries() -> dict[str, str]:
    art, arts = _with(ART), _with(ART)
    state, members = _with(STATE), _with(STATE, MEMBER)
    lab = _with(LAB)
    hist = _with(*BY_ISSUE, POLLS, CALENDAR)
    spread = "SELECT count(*) AS groups, sum(n) AS articles, max(n) AS biggest, round(max(n) / sum(n)::DOUBLE, 6) AS biggest_share, list_sort(list(n))[count(*) // 2 + 1] AS median_size, count(*) FILTER (WHERE n = 1) AS singletons"
    skew = """SELECT count(*) AS groups_measured, round(max(bias) - min(bias), 6) AS spread, {} round(avg(bias), 6) AS mean_offset, max(bias) - min(bias) < 0.25 AS constant_enough FROM cal WHERE n >= 3"""
    return {
        "canonical_url": art + CANON,
        "strip_html": f"SELECT doc_id, md5({_strip('text')}) AS digest FROM (SELECT DISTINCT doc_id, text FROM documents)",
        "standfirst_trim": art + " SELECT id, CASE WHEN length(standfirst) > 120 THEN regexp_replace(substr(standfirst, 1, 120), ' [^ ]*$', '') || '…' ELSE standfirst END AS standfirst FROM art",
        "article_filing": art + FILING + " SELECT id, section, by_url, by_text, news, desk FROM f1",
        "news_split": art + FILING + " SELECT outlet_id, count(*) FILTER (WHERE news) AS news, count(*) FILTER (WHERE NOT news) AS other FROM f1 GROUP BY 1",
        "title_signature": art + f" SELECT id, {TITLE_SIG} AS sig, len({TITLE_TOKENS}) AS tokens FROM art",
        "story_names": _with(NOW) + rf""", n0 AS (SELECT story_id, regexp_replace(trim(regexp_replace(trim(coalesce(name, ''), ' '), '^"+|"+$', '', 'g'), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g') AS n FROM now_story)
          SELECT story_id, CASE WHEN n <> '' AND len(string_split(n, ' ')) BETWEEN 2 AND 6 AND length(n) <= 42 AND NOT contains(n, '?') AND NOT regexp_matches(n, {_q(rf'(?i)\b({T.LOADED_WORDS})\b')})
          THEN upper(substr(n, 1, 1)) || substr(n, 2) ELSE '(unnamed)' END AS name FROM n0""",
        "parse_dates": art + " SELECT id, date_trunc('second', published_at) AS from_rfc, date_trunc('second', published_at) AS from_iso FROM art WHERE year(published_at) BETWEEN 1000 AND 9999",
        "tolerant_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "local_days": art + f" SELECT CAST({LONDON.format('first_seen')} AS VARCHAR) AS day, CAST(CAST(first_seen AT TIME ZONE 'UTC' AS DATE) - DATE '2020-01-01' AS INTEGER) AS day_index, count(*) AS n FROM art GROUP BY 1, 2",
        "dup_exact": arts + DUP_BASE + " SELECT kind, first_id, n, outlets FROM same",
        "dup_similar_pairs": arts + DUP_BASE + " SELECT a, b FROM near",
        "dup_groups": arts + DUP_GROUPS + " SELECT id, group_id, method FROM grp",
        "duplication_rate": arts + DUP_GROUPS + " SELECT sum(n) AS articles, sum(n - 1) AS duplicates, round(sum(n - 1) / sum(n)::DOUBLE, 6) AS rate FROM (SELECT count(*) AS n FROM grp GROUP BY group_id)",
        "outlet_report": arts + DUP_GROUPS + """, dd AS (SELECT prep.outlet_id, count(*) OVER (PARTITION BY group_id) > 1 AS dup FROM grp JOIN prep ON prep.id = grp.id)
          SELECT CASE WHEN grouping(outlet_id) = 1 THEN 'TOTAL' ELSE outlet_id END AS outlet, count(*) AS articles, count(*) FILTER (WHERE dup) AS duplicated, round(count(*) FILTER (WHERE dup) / count(*)::DOUBLE, 6) AS dup_share FROM dd GROUP BY ROLLUP (outlet_id)""",
        "token_rarity": art + VEC + " SELECT token, df, round(idf, 6) AS idf FROM rar",
        "hashed_vectors": art + VEC + f""", vb AS (SELECT token, idf, {FNV} AS h FROM rar), tf AS (SELECT id, token, count(*) AS c FROM w1 GROUP BY 1, 2),
          vp AS (SELECT id, CAST(h % 512 AS INTEGER) AS bucket, sum((1 + ln(c)) * idf * CASE WHEN ((h >> 16) & 1) = 1 THEN 1 ELSE -1 END) AS x FROM tf JOIN vb USING (token) GROUP BY 1, 2),
          vn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM vp GROUP BY id) SELECT id, bucket, round(x / norm, 6) AS value FROM vp JOIN vn USING (id) WHERE norm > 0""",
        "token_hash": art + f", tt AS (SELECT DISTINCT unnest({TITLE_TOKENS}) AS token FROM art) SELECT token, {FNV} AS h FROM tt",
        "centroids": "WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT label, dim, sum(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1) SELECT label, CAST(dim AS INTEGER) AS dim, round(x / norm, 6) AS value FROM s JOIN n USING (label)",
        "nearest_centroid": """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT label, dim, sum(x) AS x FROM p GROUP BY 1, 2),
          c AS (SELECT label AS g, list(x ORDER BY dim) AS c FROM s GROUP BY 1), sim AS (SELECT vec_id, g, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, c)
          SELECT vec_id, g AS label, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, g) AS rn FROM sim) WHERE rn = 1""",
        "cosine_search": "SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.3",
        "feed_health": _with(POLLS) + """, t AS (SELECT max(polled_at) AS now FROM pl),
          l AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY polled_at DESC, id DESC) AS rn, error IS NULL AND coalesce(n_items, 0) > 0 AS ok, epoch((SELECT now FROM t) - polled_at) / 3600.0 AS age FROM pl),
          h AS (SELECT * FROM l WHERE rn <= 60), o AS (SELECT *, first_value(items_hash) OVER w AS newest FROM h WHERE ok WINDOW w AS (PARTITION BY feed_id ORDER BY rn)),
          b AS (SELECT *, max(CASE WHEN items_hash IS DISTINCT FROM newest THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS broken FROM o),
          g AS (SELECT feed_id, list_sort(list(n_items))[count(*) // 2 + 1] AS typical, arg_min(n_items, rn) AS latest, max(polled_at) AS last_ok, min(polled_at) FILTER (WHERE broken = 0) AS run_start, count(*) AS n_ok,
            count(*) FILTER (WHERE items_hash IS NOT DISTINCT FROM newest) AS n_same, min(rn) - 1 AS fails, count(*) FILTER (WHERE age <= 24) AS looks, max(age) AS span, min(age) AS h_ok FROM b GROUP BY feed_id),
          a AS (SELECT feed_id, count(*) AS n FROM h GROUP BY 1),
          z AS (SELECT a.feed_id, coalesce(typical, 0) AS typical, coalesce(latest, 0) AS latest, last_ok, CASE WHEN n_ok = n_same AND n_ok > 1 THEN NULL ELSE run_start END AS last_changed, coalesce(fails, n) AS fails, coalesce(looks, 0) AS looks, span, h_ok IS NULL OR h_ok > 3 AS silent FROM a LEFT JOIN g USING (feed_id))
          SELECT feed_id, typical, latest, strftime(last_ok AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_ok, strftime(last_changed AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_changed, fails, looks, silent AS not_answering,
            NOT silent AND typical > 0 AND latest < typical * 0.35 AS thin, looks >= 3 AND coalesce(span, 0) >= 24 AND (last_changed IS NULL OR epoch((SELECT now FROM t) - last_changed) / 3600.0 > 24) AS frozen FROM z""",
        "last_good_poll": _with(POLLS) + """ SELECT f.id AS feed_id, o.name, strftime(max(p.polled_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_good FROM feed f JOIN outlet o ON o.id = f.outlet_id
          LEFT JOIN pl p ON p.feed_id = f.id AND p.error IS NULL AND p.n_items > 0 WHERE f.active GROUP BY f.id, o.name HAVING max(p.polled_at) IS NULL OR max(p.polled_at) < TIMESTAMPTZ '2026-03-25 00:00:00+00'""",
        "positions": _with(POS) + " SELECT poll_id, article_id, position FROM pos",
        "best_position": _with(POS) + " SELECT article_id, min(position) AS best, CASE WHEN min(position) < 5 THEN 3 WHEN min(position) < 15 THEN 2 ELSE 1 END AS prominence FROM pos GROUP BY 1",
        "fingerprints": _with(POS) + " SELECT poll_id, substr(sha1(string_agg(article_id::VARCHAR, '|' ORDER BY position)), 1, 16) AS items_hash FROM pos GROUP BY 1",
        "upsert_feeds": """SELECT url, outlet_id, CASE WHEN length(url) % 3 <> 0 THEN 'top' ELSE kind END AS kind, length(url) % 3 <> 0 AS active FROM feed
          UNION ALL SELECT url || '?new', outlet_id, 'section', true FROM feed""",
        "frame_stories": BY_ARTICLE + ", " + FIT + " SELECT story_id, articles, scored, outlets, round(atan2(ay / aw, ax / aw), 6) AS angle, round(mean, 6) AS stance, round(CASE WHEN pts > 1 THEN mean + slope * (lo_x - mx) * 0.88 ELSE mean END, 6) AS stance_lo, round(CASE WHEN pts > 1 THEN mean + slope * (hi_x - mx) * 0.88 ELSE mean END, 6) AS stance_hi FROM fit",
        "frame_top": BY_ARTICLE + ", " + FIT + ", top AS (SELECT story_id, articles, outlets FROM fit ORDER BY articles DESC, story_id LIMIT 40) SELECT story_id, articles, outlets, round(0.09 + 0.83 * CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY outlets DESC, story_id) - 1) / (count(*) OVER () - 1)::DOUBLE ELSE 0 END, 6) AS ring FROM top",
        "member_counts": _with(STATE, MEMBER, NOW) + " SELECT ns.story_id, count(m.article_id) AS n FROM now_story ns LEFT JOIN mem m ON m.story_id = ns.story_id GROUP BY 1",
        "story_lifetimes": _with(NOW) + ", d AS (SELECT CAST(last_seen AT TIME ZONE 'UTC' AS DATE) - CAST(first_seen AT TIME ZONE 'UTC' AS DATE) + 1 AS s FROM now_story WHERE status IS DISTINCT FROM 'merged'), q AS (SELECT list_sort(list(s)) AS l, count(*) AS n FROM d WHERE s IS NOT NULL) SELECT n, l[n // 2 + 1] AS median, l[least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) + 1] AS p90, l[n] AS longest, len(list_filter(l, lambda x: x = 1)) AS one_day FROM q",
        "story_spread": _with(STATE, MEMBER, NOW) + f", c AS (SELECT ns.story_id, count(m.article_id) AS n FROM now_story ns JOIN mem m ON m.story_id = ns.story_id GROUP BY 1) {spread} FROM c",
        "history_volume": hist + ", " + VOL + " SELECT story_id, CAST(day AS VARCHAR) AS day, round(vol, 6) AS vol FROM vol",
        "history_stance": hist + f""", sc AS (SELECT outlet_id, day + k AS day, sum(stance * {WEIGHT} * c) / sum({WEIGHT} * c) AS mean FROM rows_, (VALUES (0, 1.0), (1, 0.5), (2, 0.25)) AS z(k, c) WHERE stance IS NOT NULL GROUP BY 1, 2),
          dn AS (SELECT outlet_id, CAST(unnest(generate_series(min(day), (SELECT max(day) FROM cal), INTERVAL 1 DAY)) AS DATE) AS day FROM sc GROUP BY 1)
          SELECT dn.outlet_id, CAST(dn.day AS VARCHAR) AS day, round(last_value(mean IGNORE NULLS) OVER (PARTITION BY dn.outlet_id ORDER BY dn.day ROWS UNBOUNDED PRECEDING), 6) AS stance FROM dn LEFT JOIN sc ON sc.outlet_id = dn.outlet_id AND sc.day = dn.day""",
        "gap_bridge": hist + """, ov AS (SELECT outlet_id, day + k AS day, sum(n * w) AS vol FROM (SELECT outlet_id, day, count(DISTINCT article_id) AS n FROM rows_ GROUP BY 1, 2), (VALUES (0, 1.0), (1, 0.5), (2, 0.25)) AS c(k, w) GROUP BY 1, 2),
          f AS (SELECT o.outlet_id, cal.day, polled, coalesce(vol, 0) AS vol FROM (SELECT DISTINCT outlet_id FROM ov) o CROSS JOIN cal LEFT JOIN ov ON ov.outlet_id = o.outlet_id AND ov.day = cal.day),
          g AS (SELECT f.*, (SELECT max(day) FROM f x WHERE x.outlet_id = f.outlet_id AND x.polled AND x.day < f.day) AS a, (SELECT min(day) FROM f x WHERE x.outlet_id = f.outlet_id AND x.polled AND x.day > f.day) AS b FROM f)
          SELECT g.outlet_id, CAST(g.day AS VARCHAR) AS day, round(CASE WHEN g.polled OR a IS NULL THEN g.vol WHEN b IS NOT NULL THEN p.vol + (q.vol - p.vol) * (g.day - a) / (b - a)::DOUBLE ELSE p.vol END, 6) AS vol
          FROM g LEFT JOIN f p ON p.outlet_id = g.outlet_id AND p.day = a LEFT JOIN f q ON q.outlet_id = g.outlet_id AND q.day = b""",
        "top_per_day": hist + ", " + VOL + " SELECT CAST(day AS VARCHAR) AS day, story_id, round(vol, 6) AS vol, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY vol DESC, story_id) AS place FROM vol WHERE vol > 0) WHERE place <= 5",
        "risers": hist + ", " + VOL + ", " + RISE + " SELECT CAST(day AS VARCHAR) AS day, story_id, round(rise, 6) AS rise FROM best",
        "headlines": _with(*BY_ISSUE) + """, h AS (SELECT story_id, outlet_id, article_id, max(day) AS day, max(CASE WHEN article_id % 20 < 5 THEN 3 WHEN article_id % 20 < 15 THEN 2 ELSE 1 END) AS prominence FROM rows_ GROUP BY 1, 2, 3)
          SELECT story_id, outlet_id, article_id, CAST(day AS VARCHAR) AS day, prominence, place FROM (SELECT *, row_number() OVER (PARTITION BY story_id, outlet_id ORDER BY prominence DESC, day DESC, article_id) AS place FROM h) WHERE place <= 3""",
        "event_captions": hist + ", " + VOL + ", " + RISE + """, pk AS (SELECT story_id, day, title, row_number() OVER (PARTITION BY story_id, day ORDER BY CASE outlet_id WHEN 'heron' THEN 1 WHEN 'ledger' THEN 2 ELSE 3 END, outlet_id, article_id) AS rn FROM rows_)
          SELECT CAST(b.day AS VARCHAR) AS day, b.story_id, coalesce(pk.title, ns.name) AS caption FROM best b LEFT JOIN pk ON pk.story_id = b.story_id AND pk.day = b.day AND pk.rn = 1 LEFT JOIN now_story ns ON ns.story_id = b.story_id""",
        "agreement_kappa": _with(LAB, KAPPA) + " SELECT n, round(kappa, 6) AS kappa FROM kap",
        "agreement_summary": lab + """ SELECT count(*) AS n_items, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_compared, round(avg(CASE WHEN a = b THEN 1 WHEN a <> b THEN 0 END), 6) AS exact,
          round(avg(CASE WHEN abs(a - b) <= 1 THEN 1 WHEN abs(a - b) > 1 THEN 0 END), 6) AS within_1, round(avg(CASE WHEN sign(a) = sign(b) THEN 1 WHEN sign(a) <> sign(b) THEN 0 END), 6) AS same_sign,
          count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS both_abstained, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS only_a_scored, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS only_b_scored FROM pairs""",
        "worst_disagreements": lab + " SELECT article_id, issue_id, a, b, abs(a - b) AS gap FROM pairs WHERE abs(a - b) > 0 ORDER BY gap DESC, article_id NULLS FIRST, issue_id NULLS FIRST LIMIT 20",
        "calibrate": _with(ART, LAB, PO_OUTLET, CAL) + " SELECT grp, n, round(bias, 6) AS bias, round(mae, 6) AS mae, round(sd, 6) AS sd, round(within_1, 6) AS within_1, round(same_sign, 6) AS same_sign FROM cal",
        "skew_verdict": _with(ART, LAB, PO_OUTLET, CAL) + " " + skew.format("arg_min(grp, (bias, grp)) AS worst_low, arg_max(grp, (bias, grp)) AS worst_high,"),
        "offset_stability": _with(LAB, PO_ISSUE, CAL) + " " + skew.format(""),
        "outlet_means": _with(ART, LAB, PO_OUTLET) + " SELECT outlet_id, round(avg(a), 6) AS before, round(avg(b), 6) AS after, count(*) AS n FROM po WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
        "switch_verdict": _with(ART, LAB, PO_OUTLET, KAPPA) + """, ag AS (SELECT avg(CASE WHEN sign(a) = sign(b) THEN 1 WHEN sign(a) <> sign(b) THEN 0 END) AS same_sign FROM pairs),
          om AS (SELECT outlet_id, avg(a) AS x, avg(b) AS y FROM po WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1), co AS (SELECT corr(x, y) AS corr FROM om)
          SELECT round(kappa, 6) AS kappa, round(same_sign, 6) AS same_sign, round(corr, 6) AS corr, CASE WHEN kappa >= 0.6 AND same_sign >= 0.85 AND corr >= 0.8 THEN 'CLOSE ENOUGH' WHEN kappa >= 0.4 AND corr >= 0.6 THEN 'WITH CARE' ELSE 'NOT GOOD ENOUGH' END AS verdict FROM kap, ag, co""",
        "referee": lab + " SELECT count(*) FILTER (WHERE sign(a) = sign(b)) AS correct, count(*) FILTER (WHERE sign(a) = -sign(b)) AS backwards, count(*) FILTER (WHERE a = 0) AS neutral, count(*) FILTER (WHERE a IS NULL) AS missing FROM pairs WHERE b IS NOT NULL AND b <> 0",
        "consensus": lab + " SELECT article_id, issue_id, CAST(round_even(avg(score), 0) AS INTEGER) AS score, count(score) AS labellers FROM lab WHERE model IN ('judge-a', 'judge-b') GROUP BY 1, 2",
        "direction_test": _with(ART, STATE) + """, s AS (SELECT state.issue_id, stance, CASE WHEN leaning < -0.15 THEN 'left' WHEN leaning > 0.15 THEN 'right' END AS side FROM state JOIN art ON art.id = article_id LEFT JOIN outlet ON outlet.id = art.outlet_id WHERE state.issue_id IS NOT NULL),
          g AS (SELECT issue_id, CAST(length(issue_id) % 3 - 1 AS INTEGER) AS want, count(stance) FILTER (WHERE side = 'left') AS nl, count(stance) FILTER (WHERE side = 'right') AS nr, avg(stance) FILTER (WHERE side = 'left') - avg(stance) FILTER (WHERE side = 'right') AS diff FROM s GROUP BY 1)
          SELECT issue_id, want, nl AS n_left, nr AS n_right, CASE WHEN nl >= 4 AND nr >= 4 AND want <> 0 THEN round(diff, 6) END AS diff,
          CASE WHEN want = 0 THEN 'NO ASSERTION' WHEN nl < 4 OR nr < 4 THEN 'TOO FEW' WHEN abs(diff) < 0.15 THEN 'INCONCLUSIVE' WHEN sign(diff) = want THEN 'ok' ELSE 'INVERTED' END AS verdict FROM g""",
        "leaning_order": _with(ART, STATE) + ", m AS (SELECT art.outlet_id, leaning, avg(stance) AS st FROM state JOIN art ON art.id = article_id JOIN outlet ON outlet.id = art.outlet_id GROUP BY 1, 2), r AS (SELECT row_number() OVER (ORDER BY leaning, outlet_id) AS rx, row_number() OVER (ORDER BY st, outlet_id) AS ry FROM m WHERE st IS NOT NULL) SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r",
        "unscored_articles": _with(STATE, MEMBER, NOW) + " SELECT m.article_id, m.story_id FROM mem m JOIN now_story ns ON ns.story_id = m.story_id AND ns.target <> '' WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.article_id = m.article_id AND s.issue_id IS NOT DISTINCT FROM ns.issue_id AND s.rubric_version = 'r5')",
        "group_packs": members + " SELECT article_id, story_id, CAST((row_number() OVER (PARTITION BY story_id ORDER BY article_id) - 1) // 20 AS INTEGER) AS pack FROM mem",
        "scored_by_model": _with(ART, STATE, MEMBER) + " SELECT article_id, CASE WHEN coalesce(title, '') = '' THEN NULL ELSE CAST(length(title) % 5 - 2 AS DOUBLE) END AS score FROM mem JOIN art ON art.id = article_id",
        "stratified_sample": _with(ART, STATE, STRAT) + " SELECT id, outlet_id, issue_id FROM sam",
        "sample_coverage": _with(ART, STATE, STRAT) + " SELECT 'outlet' AS kind, outlet_id AS name, count(*) AS n, count(*) < 20 AS too_thin FROM sam GROUP BY 2 UNION ALL SELECT 'issue', issue_id, count(*), false FROM sam GROUP BY 2",
        "whole_story_draw": members + ", g AS (SELECT story_id, count(*) AS c FROM mem GROUP BY 1), o AS (SELECT story_id, coalesce(sum(c) OVER (ORDER BY md5('1|' || story_id::VARCHAR), story_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT article_id AS id, mem.story_id AS group_id FROM mem JOIN o ON o.story_id = mem.story_id WHERE before < 300",
        "gap_tiers": """WITH v AS (SELECT DISTINCT (p_size * p_size)::DOUBLE AS v FROM part), r AS (SELECT v, v / lag(v) OVER (ORDER BY v) AS ratio, row_number() OVER (ORDER BY v) AS nth FROM v),
          c AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ratio DESC NULLS LAST, nth DESC) < 6 AND coalesce(ratio, 0) > 1.08 THEN 1 ELSE 0 END AS cut FROM r) SELECT v AS size, CAST(sum(cut) OVER (ORDER BY v) AS INTEGER) AS tier FROM c""",
        "archive_as_of": _with(FIRST_STATE) + " SELECT article_id, issue_id, seq FROM had",
        "archive_difference": _with(STATE, FIRST_STATE) + """ SELECT coalesce(s.article_id, h.article_id) AS article_id, coalesce(s.issue_id, h.issue_id) AS issue_id, CASE WHEN s.seq IS NULL THEN 'deleted' ELSE 'set' END AS change
          FROM had h FULL JOIN state s ON h.article_id = s.article_id AND h.issue_id IS NOT DISTINCT FROM s.issue_id
          WHERE s.seq IS NULL OR h.seq IS NULL OR h.stance IS DISTINCT FROM s.stance OR h.confidence IS DISTINCT FROM s.confidence OR h.rubric_version IS DISTINCT FROM s.rubric_version""",
        "archive_restore": _with(POS) + " SELECT poll_id, article_id, position FROM pos",
        "corrected_stories": _with(STATE, NOW) + """, f AS (SELECT *, story_id % 100 = 0 AS hit FROM now_story)
          SELECT f.story_id AS id, CASE WHEN hit THEN 'corrected-issue' ELSE f.issue_id END AS issue_id, CASE WHEN hit THEN 'corrected target' ELSE target END AS target, CASE WHEN hit THEN 'corrected' ELSE target_conf END AS target_conf,
          count(s.seq) FILTER (WHERE NOT hit OR NOT coalesce(s.scored_at < TIMESTAMPTZ '2026-04-01 00:00:00+00', false)) AS scores FROM f LEFT JOIN state s ON s.story_id = f.story_id GROUP BY f.story_id, hit, f.issue_id, target, target_conf""",
        "robots_decisions": """WITH f AS (SELECT DISTINCT '/' || regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM feed)
          SELECT 'site' AS site, 'readerbot' AS agent, path, 'readerbot' AS via, NOT starts_with(path, '/home/') AS allowed FROM f
          UNION ALL SELECT 'site', 'anyone', path, '*', NOT starts_with(path, '/front') OR starts_with(path, '/front/1') FROM f""",
    }

"""DuckDB SQL for the registered queries, written against the raw test tables."""

from __future__ import annotations

NEWS = """news AS (
  SELECT doc_id AS row_ord, text AS body, substr(text, 1, 60) AS title, coalesce(url, '') AS url,
    CASE WHEN doc_id % 5 = 0 THEN 'HK' ELSE 'US' END AS market,
    CASE WHEN doc_id % 11 = 0 THEN [] ELSE ['T' || (doc_id % 20)] END AS security_ids,
    make_timestamp(1704067200000000 + (doc_id % 700) * 3600000000) AS published_at,
    CASE WHEN doc_id % 13 <> 0 THEN make_timestamp(1704067200000000 + (doc_id % 700 + doc_id % 72) * 3600000000) END AS available_at,
    make_timestamp(1704067200000000 + (doc_id % 700 + 1) * 3600000000) AS received_at,
    ['title', 'abstract', 'official_excerpt', 'source_excerpt', 'full_text', 'numeric', 'none'][doc_id % 7 + 1] AS evidence_scope,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'c' || ((doc_id * 7) % 900) END AS event_cluster,
    CASE WHEN doc_id % 9 <> 0 THEN 'w' || (doc_id % 40) END AS workflow_task_id
  FROM documents LEFT JOIN (SELECT page_id, url FROM pages) p ON p.page_id = doc_id % 50)"""
REVIEWS = """reviews AS (
  SELECT event_id AS row_ord, CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 > 0 THEN user_id || '-' || (event_id % 40) END AS task_id,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 'e' || event_id END AS own_id, 'https://e.example/' || (event_id % 700) AS url,
    CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 2 ELSE 14 END AS half_life,
    event_id % 3 - 1 AS direction_sign, CASE WHEN event_id % 17 = 3 THEN 'insufficient' ELSE ['bearish', 'neutral', 'bullish'][event_id % 3 + 1] END AS grade,
    CASE WHEN event_id % 53 > 0 THEN CASE WHEN value < 10 THEN 1.0 WHEN value < 40 THEN 2.0 ELSE 4.0 END END::DOUBLE AS weight,
    CASE WHEN event_id % 37 > 0 THEN (json_extract_string(props, '$.k')::DOUBLE) / 100 END AS conf,
    CASE WHEN event_id % 41 > 0 THEN (100 - (event_id % 7) * 10) / 100::DOUBLE END AS rel,
    ts AS event_time, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000 + (1 + event_id % 48) * 3600000000) AS available_at,
    CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 > 0 THEN user_id || ':' || (epoch_us(ts) // 86400000000) END AS event_cluster
  FROM events)"""


def _scored(reviews: str = "(SELECT * FROM reviews WHERE conf IS NULL OR conf BETWEEN 0 AND 1)") -> str:
    """What a cutoff knows, one row a cluster, with its contribution."""
    return f"""latest AS (SELECT *, coalesce(nullif(task_id, ''), nullif(own_id, ''), url) AS review_key FROM {reviews} WHERE available_at <= TIMESTAMP '2024-01-25'
  QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(task_id, ''), nullif(own_id, ''), url) ORDER BY available_at DESC, row_ord) = 1),
assessed AS (SELECT * EXCLUDE (event_cluster), coalesce(nullif(event_cluster, ''), own_id) AS cluster FROM latest WHERE grade <> 'insufficient' AND weight IS NOT NULL),
reps AS (SELECT *, count(*) OVER c AS members, min(event_time) OVER c AS first_time FROM assessed
  WINDOW c AS (PARTITION BY cluster)
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(conf, 0) * coalesce(rel, 0) DESC, available_at DESC, row_ord) = 1),
scored AS (SELECT *, direction_sign * weight * coalesce(conf, 1) * coalesce(rel, 1)
    * exp(-ln(2) * ((epoch_us(TIMESTAMP '2024-01-25') - epoch_us(first_time)) / 86400000000.0) / half_life) AS x FROM reps)"""


SYNTHESIS = """sums AS (SELECT count(*) AS event_count, coalesce(sum(members - 1), 0)::BIGINT AS deduplicated_reprints,
    coalesce(sum(greatest(x, 0)), 0) AS p, coalesce(sum(greatest(-x, 0)), 0) AS n FROM scored),
r AS (SELECT *, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS ratio FROM sums)
SELECT event_count, deduplicated_reprints, round(p, 6) AS positive, round(n, 6) AS negative, round(p - n, 6) + 0.0 AS net, round(p + n, 6) AS gross, round(ratio, 6) + 0.0 AS normalized,
  CASE WHEN event_count = 0 THEN 'no_verified_assessment' WHEN ratio > 0.15 THEN 'bullish' WHEN ratio < -0.15 THEN 'bearish' ELSE 'neutral' END AS direction FROM r"""
WITHDRAWN = """_last AS (SELECT * FROM (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY available_at DESC, row_ord) = 1) WHERE task_id <> '' AND md5(task_id)[1] < '3' AND grade <> 'insufficient')"""


def _macro(cutoff: str) -> str:
    return f"""vintages AS (
  SELECT event_id AS row_ord, event_type AS series_id, ts::DATE AS observation_date, value,
    make_timestamp(epoch_us(ts) + (event_id % 96) * 3600000000) AS available_at FROM events),
latest AS (SELECT * FROM vintages WHERE available_at <= TIMESTAMP '{cutoff}' AND observation_date <= DATE '{cutoff}'
  QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY available_at DESC, row_ord DESC) = 1)"""


STATES = """states AS (
  SELECT conv_id AS task_id, turn AS state_ord,
    ['pending', 'unresolved', 'unrelated', 'verified'][(conv_id + turn) % 4 + 1] AS status,
    make_timestamp(1704067200000000 + ((conv_id * 3) % 600 + (turn // 2) * 24) * 3600000000) AS reviewed_at FROM conversations),
tasks AS (SELECT conv_id AS task_id, make_timestamp(1704067200000000 + ((conv_id * 5) % 900) * 3600000000) AS published_at FROM conversations GROUP BY conv_id),
now_states AS (SELECT * FROM states WHERE reviewed_at <= TIMESTAMP '2024-01-15'
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY reviewed_at DESC, state_ord) = 1)"""
ATTEMPTS = """attempts AS (
  SELECT conv_id AS task_id, turn AS attempt_ord, ['source', 'title', 'company'][turn % 3 + 1] AS kind,
    CASE WHEN length(text) % 3 = 0 THEN 'fetched' ELSE 'unavailable' END AS status FROM conversations)"""
WHITE = r"[\s\x1c-\x1f\x0b\x85\p{Z}]+"
FOLDED = rf"lower(trim(regexp_replace(body, '{WHITE}', ' ', 'g')))"
BODY_HASH = f"CASE WHEN coalesce(body, '') = '' THEN '' ELSE sha256(to_json({FOLDED})::VARCHAR) END"
_PART = "replace(url_encode(url_decode(replace({}, '+', ' '))), '%20', '+')"
URLS = f"""pieces AS (
  SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages),
heads AS (SELECT page_id, split_part(u, '?', 1) AS head, CASE WHEN strpos(u, '?') > 0 THEN substr(u, strpos(u, '?') + 1) ELSE '' END AS query FROM pieces),
params AS (SELECT page_id, head, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains(
    ['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'cmpid'], lower(split_part(p, '=', 1)))) AS kept FROM heads),
urls AS (SELECT page_id, lower(regexp_extract(head, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')) || substr(head, length(regexp_extract(head, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')) + 1)
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda p:
      {_PART.format("split_part(p, '=', 1)")} || '=' || {_PART.format("CASE WHEN strpos(p, '=') > 0 THEN substr(p, strpos(p, '=') + 1) ELSE '' END")}), '&') ELSE '' END AS canonical FROM params)"""
#: The lexicon, written out anew from its published values.
_BULLISH = "beat 2,beats 2,raise guidance 3,raised guidance 3,raises guidance 3,guidance raise 3,buyback 2,repurchase 2,dividend increase 2,raises dividend 2,approval 2,approved 2,contract win 2,wins contract 2,record revenue 2,record profit 2,upgrade 2,upgraded 2,outperform 2,partnership 1,launch 1,expansion 1,strong demand 1,profit growth 1,revenue growth 1"
_BEARISH = "miss 2,misses 2,cut guidance 3,cuts guidance 3,lower guidance 3,guidance cut 3,lawsuit 2,investigation 2,probe 2,recall 2,downgrade 2,downgraded 2,underperform 2,bankruptcy 4,default 3,fraud 4,restatement 3,resignation 1,layoffs 2,weak demand 1,profit warning 3,impairment 2"
_ENTRIES = [(e.rpartition(" ")[0], sign * int(e.rpartition(" ")[2])) for text, sign in ((_BULLISH, 1), (_BEARISH, -1)) for e in text.split(",")]
WORDS = "[" + ", ".join(f"{{'p': '{p}', 'w': {w}}}" for p, w in _ENTRIES) + "]"
SIZES = "[{'p': 'record', 'w': 1}, {'p': 'major', 'w': 1}, {'p': 'significant', 'w': 1}, {'p': 'substantial', 'w': 1}, {'p': 'minor', 'w': -1}, {'p': 'slight', 'w': -1}, {'p': 'small', 'w': -1}]"


def _sum_of(table: str, text: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter({table}, lambda e: contains(lower({text}), e.p)), lambda e: e.w)), 0)"


TOKENS = rf"list_filter(regexp_split_to_array(text, '{WHITE}'), lambda w: w <> '')"
ADMITTED = "evidence_scope IN ('full_text', 'official_excerpt', 'numeric', 'source_excerpt')"
VISIBLE = """visible AS (SELECT * FROM news WHERE coalesce(available_at, received_at, published_at) <= TIMESTAMP '2024-02-05'
  AND (published_at IS NULL OR published_at >= TIMESTAMP '2024-02-05' - INTERVAL 20 DAY))"""
INVALID = """CASE WHEN direction_sign NOT IN (-1, 0, 1) THEN 'direction_sign' WHEN weight IS NULL THEN 'impact_level' WHEN conf NOT BETWEEN 0 AND 1 THEN 'evidence_confidence'
  WHEN rel NOT BETWEEN 0 AND 1 THEN 'stock_relevance' WHEN event_time IS NULL OR event_time > TIMESTAMP '{}' THEN 'event_time' END"""

ORACLE_SQL = {
    "news_asof_window": f"WITH {NEWS}, {VISIBLE} SELECT row_ord, market, epoch_us(published_at) AS published_at, epoch_us(available_at) AS available_at FROM visible",
    "security_semi_or_marketwide": f"WITH {NEWS} SELECT row_ord, array_to_string(security_ids, ',') AS ids FROM news WHERE market = 'US' AND (len(security_ids) = 0 OR list_has_any(security_ids, ['T3', 'T7']))",
    "canonical_urls": f"WITH {URLS} SELECT page_id, canonical FROM urls",
    "body_hash_dups": f"""WITH {NEWS}, odd AS (SELECT row_ord, CASE row_ord % 50 WHEN 0 THEN ' ' || chr(9) || chr(10) WHEN 1 THEN CASE WHEN row_ord // 50 % 32 = 0 THEN NULL ELSE 'a' || chr((row_ord // 50 % 32)::INT) || 'b " ' END ELSE body END AS body FROM news)
SELECT {BODY_HASH} AS body_hash, count(*) AS n, min(row_ord) AS first FROM odd GROUP BY 1 HAVING count(*) > 1""",
    "greedy_dedupe": f"""WITH RECURSIVE {NEWS}, {URLS}, keyed AS MATERIALIZED (
  SELECT row_ord, row_number() OVER (ORDER BY coalesce(epoch_us(available_at), epoch_us(published_at)) DESC, row_ord) AS pos,
    CASE WHEN news.url <> '' THEN canonical || '#' || (row_ord % 400) ELSE '' END AS k0, {BODY_HASH} AS k1, event_cluster AS k2
  FROM news LEFT JOIN urls ON urls.page_id = row_ord % 50),
scan AS (
  SELECT 0::BIGINT AS pos, NULL::BIGINT AS row_ord, NULL::BIGINT AS owner, MAP {{}}::MAP(VARCHAR, BIGINT) AS seen
  UNION ALL
  SELECT pos, row_ord, owner, CASE WHEN owner IS NULL THEN map_concat(seen, map_from_entries(list_transform(list_filter([('0' || k0), ('1' || k1), ('2' || k2)], lambda x: length(x) > 1), lambda x: {{'k': x, 'v': row_ord}}))) ELSE seen END
  FROM (SELECT k.pos, k.row_ord, k.k0, k.k1, k.k2, s.seen,
    coalesce(CASE WHEN k0 <> '' THEN s.seen['0' || k0] END, CASE WHEN k1 <> '' THEN s.seen['1' || k1] END, CASE WHEN k2 <> '' THEN s.seen['2' || k2] END) AS owner
    FROM scan s JOIN keyed k ON k.pos = s.pos + 1))
SELECT row_ord, owner IS NULL AS kept, owner AS duplicate_of FROM scan WHERE pos > 0""",
    "lexicon_grade": f"""WITH {NEWS}, t AS (SELECT *, row_ord % 42 = 0 AS given, coalesce(CASE WHEN row_ord % 10 <> 1 THEN nullif(body, '') END, nullif(title, ''), '') AS txt FROM news),
u AS (SELECT *, {_sum_of("WORDS_", "txt")} AS b, {_sum_of("SIZES_", "txt")} AS size, array_to_string(list_sort(list_transform(list_filter(WORDS_, lambda e: contains(lower(txt), e.p)), lambda e: e.p)), ',') AS found FROM t),
v AS (SELECT *, CASE WHEN b > 0 THEN b + size WHEN b < 0 THEN b - size ELSE b END AS s FROM u)
SELECT row_ord,
  CASE WHEN NOT ({ADMITTED}) THEN 'insufficient' WHEN given THEN 'bullish' WHEN trim(txt) = '' THEN 'insufficient' ELSE CASE
    WHEN s >= 5 THEN 'very_bullish' WHEN s >= 3 THEN 'bullish' WHEN s >= 1 THEN 'moderately_bullish'
    WHEN s <= -5 THEN 'very_bearish' WHEN s <= -3 THEN 'bearish' WHEN s <= -1 THEN 'moderately_bearish' ELSE 'neutral' END END AS grade,
  CASE WHEN NOT ({ADMITTED}) THEN 'evidence_scope=' || evidence_scope WHEN given THEN 'given' WHEN trim(txt) = '' THEN 'empty_text' WHEN found <> '' THEN 'hits=' || found ELSE 'no_recognized_terms' END AS grade_reason,
  CASE WHEN NOT ({ADMITTED}) OR (trim(txt) = '' AND NOT given) THEN 'insufficient_evidence' WHEN given THEN 'source_review' ELSE 'lexicon' END AS grade_method, s::BIGINT AS score
FROM v""".replace("WORDS_", WORDS).replace("SIZES_", SIZES),
    "event_impact_decay": f"""WITH {REVIEWS} SELECT row_ord, round(direction_sign * weight * coalesce(conf, 1) * coalesce(rel, 1)
    * exp(-ln(2) * ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(event_time)) / 86400000000.0) / half_life), 6) + 0.0 AS contribution, {INVALID.format('2024-02-01')} AS invalid FROM reviews""",
    "supersede_reviews": f"WITH {REVIEWS}, {_scored('reviews')} SELECT review_key, row_ord, grade, epoch_us(available_at) AS available_at FROM latest",
    "cluster_representatives": f"WITH {REVIEWS}, {_scored()} SELECT cluster AS event_cluster, row_ord, members, epoch_us(first_time) AS event_time FROM reps",
    "impact_synthesis": f"WITH {REVIEWS}, {_scored()}, {SYNTHESIS}",
    "retracted_impact": f"""WITH {REVIEWS}, {WITHDRAWN.replace('FROM reviews QUALIFY', 'FROM reviews WHERE conf IS NULL OR conf BETWEEN 0 AND 1 QUALIFY')},
appended AS (SELECT * FROM reviews WHERE conf IS NULL OR conf BETWEEN 0 AND 1 UNION ALL BY NAME SELECT * REPLACE (row_ord + 1000000000 AS row_ord, 'insufficient' AS grade, NULL AS weight, '' AS own_id, TIMESTAMP '2024-01-24' AS available_at) FROM _last),
{_scored('appended')}, {SYNTHESIS}""",
    "contribution_topk": f"WITH {REVIEWS}, {_scored()} SELECT row_ord, cluster AS event_cluster, round(x, 6) + 0.0 AS contribution FROM scored ORDER BY abs(round(x, 6)) DESC, row_ord LIMIT 20",
    "macro_latest_vintage": f"WITH {_macro('2024-01-20')} SELECT series_id, observation_date::VARCHAR AS day, row_ord, value FROM latest",
    "macro_lag20": f"""WITH {_macro('2024-01-28')}, l AS (SELECT series_id, observation_date, value, lag(value, 20) OVER (PARTITION BY series_id ORDER BY observation_date) AS past,
    count(*) OVER (PARTITION BY series_id) AS n FROM latest QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY observation_date DESC) = 1)
SELECT series_id, 'difference' AS kind, round(CASE WHEN n >= 21 THEN value - past END, 6) AS change, CASE WHEN n < 21 THEN 'window_insufficient' ELSE 'ok' END AS reason, observation_date::VARCHAR AS latest FROM l
UNION ALL SELECT series_id, 'log', round(CASE WHEN n >= 21 AND value > 0 AND past > 0 THEN ln(value / past) END, 6), CASE WHEN n < 21 THEN 'window_insufficient' WHEN value <= 0 OR past <= 0 THEN 'nonpositive_base' ELSE 'ok' END, observation_date::VARCHAR FROM l""",
    "macro_nearest_year": """WITH y AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS d, sum(round(o_totalprice * 100)::BIGINT) / count(*) / 100 AS value FROM orders GROUP BY 1, 2),
m AS (SELECT *, max(d) OVER s AS last_date, count(*) OVER s AS n FROM y WINDOW s AS (PARTITION BY series_id)),
p AS (SELECT series_id, value AS past, d AS prior FROM m WHERE d < last_date QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(date_diff('day', d, last_date) - 365), d) = 1)
SELECT m.series_id, round(CASE WHEN n >= 13 AND past > 0 THEN (m.value / past - 1) * 100 END, 6) AS yoy, CASE WHEN n < 13 THEN 'window_insufficient' WHEN past > 0 THEN 'ok' ELSE 'nonpositive_base' END AS reason, prior::VARCHAR AS prior
FROM m LEFT JOIN p USING (series_id) WHERE m.d = m.last_date""",
    "macro_spread": f"WITH {_macro('2024-01-20')} SELECT round(a - b, 6) AS spread FROM (SELECT arg_max(value, observation_date) AS a FROM latest WHERE series_id = 'purchase'), (SELECT arg_max(value, observation_date) AS b FROM latest WHERE series_id = 'view') WHERE a IS NOT NULL AND b IS NOT NULL",
    "identity_resolve_interval": """WITH sec AS (SELECT 'SEC' || c_custkey AS security_id, 'K' || (c_custkey % 97) AS ticker, CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE 'HK' END AS market,
    DATE '2020-01-01' + (c_custkey % 1500)::INT AS valid_from, CASE WHEN c_custkey % 4 <> 0 THEN DATE '2020-01-01' + (c_custkey % 1500 + c_custkey % 400)::INT END AS valid_to FROM customer),
req AS (SELECT (n_nationkey * 100 + k)::BIGINT AS request_id, 'K' || ((n_nationkey * 41 + k) % 110) AS ticker, CASE WHEN n_nationkey % 2 = 0 THEN 'US' ELSE 'HK' END AS market,
    DATE '2020-06-01' + (k * 30)::INT AS day FROM nation, range(0, 41) AS r(k))
SELECT request_id, CASE count(security_id) WHEN 0 THEN req.market || ':' || CASE WHEN req.market = 'HK' THEN 'XHKG' ELSE 'XNAS' END || ':' || req.ticker WHEN 1 THEN min(security_id) ELSE 'ambiguous' END AS security_id, count(security_id) AS matches
FROM req LEFT JOIN sec ON sec.ticker = req.ticker AND sec.market = req.market AND day >= valid_from AND (valid_to IS NULL OR day <= valid_to) GROUP BY request_id, req.market, req.ticker""",
    "task_queue_prepare": f"""WITH {NEWS} SELECT workflow_task_id, row_ord FROM news WHERE market = 'US' AND (len(security_ids) = 0 OR list_has_any(security_ids, ['T1', 'T2', 'T3', 'T4']))
    AND workflow_task_id IS NOT NULL AND evidence_scope IN ('title', 'abstract', 'none') QUALIFY row_number() OVER (PARTITION BY workflow_task_id ORDER BY coalesce(published_at, TIMESTAMP '2024-02-05') DESC, row_ord) = 1""",
    "coverage_asof": f"""WITH {STATES}, s AS (SELECT coalesce(status, 'pending') AS status FROM tasks LEFT JOIN now_states USING (task_id) WHERE published_at <= TIMESTAMP '2024-01-15')
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'unrelated') AS unrelated, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'verified') AS verified,
  count(*) AS total, count(*) - count(*) FILTER (status = 'pending') AS completed, count(*) FILTER (status = 'pending') = 0 AS all_processed FROM s""",
    "dispositions_apply": f"""WITH {NEWS}, {STATES} SELECT row_ord, status AS workflow_status, CASE WHEN status = 'verified' THEN 'task:' || task_id ELSE event_cluster END AS event_cluster
FROM news LEFT JOIN now_states ON task_id = row_ord % 500 WHERE status IS DISTINCT FROM 'unrelated'""",
    "review_retractions": f"""WITH {REVIEWS}, {WITHDRAWN} SELECT task_id, row_ord, 'insufficient' AS grade, 'withdrawn ' || task_id AS grade_reason, 'none' AS evidence_scope, '' AS event_id, NULL::VARCHAR AS impact_level,
  epoch_us(TIMESTAMP '2024-03-01') AS available_at FROM _last""",
    "pending_anti": f"WITH {STATES} SELECT task_id, epoch_us(published_at) AS published_at FROM tasks WHERE task_id NOT IN (SELECT task_id FROM states WHERE status = 'verified')",
    "fallback_first_success": f"""WITH {ATTEMPTS}, s AS (SELECT task_id, min(attempt_ord) FILTER (status = 'fetched') AS first, count(*) AS n FROM attempts GROUP BY 1)
SELECT s.task_id, coalesce(a.kind, 'none') AS kind, coalesce(first + 1, n)::BIGINT AS attempts, CASE WHEN first IS NULL THEN 'no_usable_evidence' ELSE 'ok' END AS reason FROM s LEFT JOIN attempts a ON a.task_id = s.task_id AND a.attempt_ord = s.first""",
    "collection_totals": f"""WITH {ATTEMPTS}, t AS (SELECT task_id, bool_or(status = 'fetched') AS got, count(*) FILTER (kind <> 'source') AS n FROM attempts GROUP BY 1)
SELECT count(*) AS total_titles, count(*) FILTER (got) AS fetched_for_review, count(*) FILTER (NOT got) AS fetch_unresolved, sum(n)::BIGINT AS search_requests FROM t""",
    "excerpt_200_words": f"""SELECT doc_id, sha256(array_to_string(({TOKENS})[1:200], ' ')) AS excerpt_sha256, len({TOKENS}) > 200 AS truncated,
  NOT regexp_matches(lower(substr(text, 1, 4000)), 'access denied|verify you are human|enable javascript and cookies|subscribe to continue|sign in to read|we do not host the original article') AND length(text) >= 300 AND len({TOKENS}) >= 40 AS usable FROM documents""",
    "publication_metadata": "SELECT event_id, (CASE event_id % 4 WHEN 0 THEN floor(epoch(ts)) WHEN 1 THEN floor(epoch(ts)) - 28800 WHEN 3 THEN floor(epoch(ts)) END)::BIGINT AS published FROM events",
    "event_id_hash": f"""WITH {NEWS}, {URLS} SELECT row_ord, 'evt-' || substr(sha256('{{"published_at":"' || CASE WHEN row_ord % 6 > 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE '' END || '","security_ids":' || CASE WHEN len(security_ids) = 0 THEN '[]' ELSE '["' || security_ids[1] || '"]' END
    || ',"title":' || to_json(lower(trim(title, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))::VARCHAR || ',"url":"' || coalesce(canonical, '') || '"}}'), 1, 16) AS event_id FROM news LEFT JOIN urls ON urls.page_id = row_ord % 50""",
    "retention_expired_groups": "SELECT l_orderkey AS group_key, count(*) AS files, sum(l_quantity::BIGINT)::BIGINT AS bytes, epoch_us(max(l_shipdate)) AS newest FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '1998-01-01' - INTERVAL 7 DAY",
    "raw_observation_merge": "SELECT sha256(props) AS sha256, count(*) AS n, epoch_us(min(ts)) AS first_observed_at, epoch_us(max(ts)) AS last_observed_at FROM events GROUP BY 1",
    "catalog_latest_snapshot": """WITH c AS (SELECT 'd' || (o_custkey % 300) AS name, lpad(o_orderkey::VARCHAR, 12, '0') AS version, o_custkey AS rows, o_orderdate AS created_at FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderdate DESC, lpad(o_orderkey::VARCHAR, 12, '0') DESC) = 1),
r AS (SELECT DISTINCT 'd' || (c_custkey % 350) AS name FROM customer)
SELECT name, version, rows, version IS NULL AS missing FROM r LEFT JOIN c USING (name)""",
    "source_policy_gate": """WITH e AS (SELECT event_id, ['sec', 'fred', 'gdelt', 'hkma', 'other'][event_id % 5 + 1] AS source, CASE WHEN event_id % 3 = 0 THEN 'hk' ELSE 'us' END AS market, ['news', 'macro', 'filings'][event_id % 7 % 3 + 1] AS dataset FROM events)
SELECT * FROM e WHERE (source = 'sec' AND market = 'us' AND dataset = 'filings') OR (source = 'fred' AND market = 'us' AND dataset = 'macro') OR (source = 'gdelt' AND dataset = 'news') OR (source = 'hkma' AND market = 'hk' AND dataset IN ('news', 'macro'))""",
    "review_admissibility_violations": f"WITH {REVIEWS}, v AS (SELECT row_ord, {INVALID.format('2024-01-20')} AS violation FROM reviews) SELECT violation, count(*) AS n, min(row_ord) AS first FROM v WHERE violation IS NOT NULL GROUP BY 1",
}


def _cell(value: str) -> str:
    return f"replace(replace(replace(replace(coalesce(nullif({value}, ''), '—'), '|', '／'), chr(10), ' '), '<', '&lt;'), '>', '&gt;')"


_OBSERVED = """o AS (SELECT event_type || (user_id % 40) AS series_id, event_id, ts::DATE AS day, ts::DATE + (event_id % 300)::INTEGER AS released,
  CASE WHEN event_id % 7 > 0 AND event_id % 11 > 0 AND event_id % 13 > 0 THEN (event_id % 1000) + 0.5::DOUBLE END AS value FROM events)"""
ORACLE_SQL |= {
    "vendor_headline_source": """SELECT 'U' || user_id AS security_id, event_type || ' ' || event_id AS title, 'https://v.example/' || event_id AS url, 'title' AS evidence_scope,
  CASE WHEN event_id % 7 > 0 THEN epoch_us(date_trunc('second', ts)) END AS published_at, published_at AS available_at FROM events WHERE event_id % 10 > 1""",
    "macro_vintage_source": f"""WITH {_OBSERVED} SELECT series_id, day::VARCHAR AS day, value, released::VARCHAR || ':9999-12-31' AS vintage_id,
  epoch_us(timezone('America/New_York', released + TIME '23:59:59')) AS available_at FROM o WHERE value IS NOT NULL""",
    "paged_source_receipt": f"""WITH {_OBSERVED} SELECT series_id, count(*) % 2 = 0 AS exhausted, count(*) % 2 = 1 AS cap_reached, count(value) AS record_count,
  min(day) FILTER (value IS NOT NULL)::VARCHAR AS coverage_start, max(day) FILTER (value IS NOT NULL)::VARCHAR AS coverage_end FROM o GROUP BY 1""",
    "candidate_sources": """WITH c AS (SELECT page_id % 20 AS task_id, CASE WHEN page_id % 7 = 0 THEN url ELSE 'https://e.example/' || (page_id % 60) END AS url, page_id FROM pages WHERE page_id % 9 > 0 AND page_id % 10 > 0),
f AS (SELECT task_id, url, min(page_id) AS seen FROM c WHERE url LIKE 'https://%' GROUP BY 1, 2)
SELECT task_id, url, row_number() OVER (PARTITION BY task_id ORDER BY seen) AS rank FROM f QUALIFY rank <= 5""",
    "archived_replay": """WITH r AS (SELECT conv_id AS task_id, 'u' || (turn % 3) AS url, arg_min(length(text) % 3 = 0, turn) AS ok, arg_min(text, turn) AS quote FROM conversations GROUP BY 1, 2),
t AS (SELECT DISTINCT conv_id + k AS task_id, k FROM conversations, (VALUES (0), (1000000000)) x(k)),
q AS (SELECT task_id, k, url FROM t, (VALUES ('u0'), ('u1'), ('u2'), ('u9')) u(url))
SELECT q.task_id, q.url, CASE WHEN ok THEN 'fetched' ELSE 'unavailable' END AS status, CASE WHEN ok IS NULL THEN CASE WHEN k = 0 THEN 'URL_not_in_archived_fetch' ELSE 'archived_fetch_missing' END END AS reason, quote
FROM q LEFT JOIN r USING (task_id, url)""",
    "evidence_table": f"""WITH e AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://e.example/' || doc_id END AS url, CASE WHEN doc_id % 3 > 0 THEN '<' || source || '|' END AS named FROM documents)
SELECT doc_id, '| ' || {_cell("substr(text, 1, 60)")} || ' | fetched | ' || CASE WHEN url = '' THEN '无来源' ELSE '[' || {_cell("coalesce(named, url)")} || '](' || url || ')' END
  || ' | ' || {_cell("lang")} || ' | ' || {_cell("CASE WHEN doc_id % 5 = 0 OR text = '' THEN 'body_missing' ELSE text END")} || ' | — |' AS line FROM e""",
}


_REVIEWED = """s AS (SELECT conv_id, turn, CASE WHEN conv_id % 17 = 0 AND turn = 1 THEN 'http' ELSE 'https' END || '://e.example/' || conv_id || '/' || turn AS url,
  CASE WHEN conv_id % 19 = 1 AND turn = 0 THEN '' ELSE 'p' || turn END AS locator FROM conversations),
r AS (SELECT conv_id, ['very_bullish', 'neutral', 'bearish'][conv_id % 3 + 1] AS grade, arg_min(url, turn) AS url, string_agg(locator, '; ' ORDER BY turn) AS evidence_locator, max(turn) AS last,
  CASE WHEN conv_id % 23 = 0 OR conv_id % 29 = 0 THEN 'uncited' WHEN conv_id % 13 % 4 = 3 THEN 'evidence_scope'
    WHEN conv_id % 2 = 0 AND conv_id % 31 = 2 THEN 'impact' WHEN conv_id % 2 = 0 AND conv_id % 11 = 0 AND conv_id % 3 <> 1 THEN 'sign'
    WHEN bool_or(locator = '' OR url LIKE 'http:%') THEN 'source' WHEN max(turn) > 6 THEN 'published_after_review' ELSE 'none' END AS problem FROM s GROUP BY conv_id)"""
ORACLE_SQL |= {
    "source_review_problems": f"WITH {_REVIEWED} SELECT conv_id, problem FROM r",
    "source_review_events": f"""WITH {_REVIEWED} SELECT conv_id, url, evidence_locator, grade, 1704067200000000 + (conv_id % 100 + last) * 3600000000 AS published_at,
  1704067200000000 + (conv_id % 100 + 6) * 3600000000 AS available_at FROM r WHERE problem = 'none'""",
    "synthesis_keys": f"""WITH {NEWS} SELECT row_ord, coalesce(workflow_task_id, CASE WHEN row_ord % 4 = 0 THEN 'e' || row_ord END, CASE WHEN row_ord % 3 > 0 THEN 'evt-' || row_ord END, url) AS synth_key FROM news""",
}

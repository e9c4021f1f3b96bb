"""DuckDB SQL for the operators that it can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""WITH lines AS (
  SELECT doc_id, u.ord, u.line, translate(trim(u.line, {_WS}), '{_UPPER}', '{_LOWER}') AS key
  FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, ord)),
often AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, o.key IS NOT NULL AND l.doc_id < o.last AS gone FROM lines l LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP10 = r"""WITH words AS (
  SELECT doc_id, u.w, u.ord FROM documents, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) WITH ORDINALITY AS u(w, ord)),
eights AS (SELECT doc_id, ord, string_agg(w, ' ') OVER e AS g, count(*) OVER e AS n FROM words WINDOW e AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT doc_id, ord FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM eights WHERE n = 8) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT ord + k) AS n_repeat_words FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own FROM documents),
m AS (SELECT d.doc_id, coalesce(source, '') AS host, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(own) - len(list_distinct(own)))::BIGINT AS n_dup_lines, len(own) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols > 0.1::DOUBLE * word_chars OR n_dup_lines > 0.3::DOUBLE * n_lines AS soft_failed FROM m),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM f GROUP BY host),
moments AS (SELECT sum(bad) / sum(n) AS m, var_pop(bad / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS s FROM moments),
rates AS (SELECT host, (bad + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.5 AND soft_failed) AS kept, round(rate, 9) AS host_rate
FROM f JOIN rates USING (host)"""

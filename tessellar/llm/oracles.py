"""SQL, in DuckDB's dialect, for the text queries that SQL can express: comparison of all windows (op2), and the rules with learned references (op7).

Neither follows its operator's plan: op2's compares every window of every text, op7's unnests words and windows to rows.
"""

from __future__ import annotations

import string

PREFIX_DECONTAMINATION = rf"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
placed AS (SELECT item, w, unnest(range(greatest(len(w) - 7, 1))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, w[i + 1 : i + 8] AS words, len(w[i + 1 : i + 8]) AS l FROM placed),
lengths AS (SELECT DISTINCT l FROM windows),
starts AS (SELECT r, w, l, unnest(range(len(w) - l + 1)) AS i FROM low, lengths WHERE len(w) >= l),
hits AS (SELECT r, item, i, s.l FROM starts s JOIN windows v ON s.l = v.l AND s.w[s.i + 1 : s.i + s.l] = v.words),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM low LEFT JOIN found USING (r) LEFT JOIN covered USING (r)
"""

#: The Jensen-Shannon distance of two lists, null if one of them is.
_DISTANCE = """sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z:
    (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0.0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0.0 END))) / 2))"""

DISTRIBUTION_RULES = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
grams AS (SELECT r, i, w[i + 1 : i + 5] AS g FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
base AS (
  SELECT doc_id, r, lang, w, CAST(len(w) AS BIGINT) AS n_words, length(t) AS n_chars,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS small, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capital,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS others
  FROM split LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_chars - word_chars AS white FROM base),
word_rows AS (SELECT r, lang, n_chars, lower(unnest(w)) AS word FROM judged),
ranked AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM word_rows WHERE n_chars >= 200 GROUP BY lang, word),
common AS (SELECT lang, word, k FROM ranked WHERE k <= 12),
grid AS (SELECT r, word, k FROM judged JOIN common USING (lang)),
seen AS (SELECT r, word, count(*) AS n FROM word_rows GROUP BY r, word),
counted AS (SELECT r, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY k) AS counts FROM grid LEFT JOIN seen USING (r, word) GROUP BY r),
hists AS (
  SELECT j.*, list_transform([small, capital, digits, others, white, n_symbols, n_chars - small - capital - digits - others - white - n_symbols], lambda x: x / greatest(n_chars, 1.0)) AS classes,
    CASE WHEN counts IS NOT NULL THEN list_transform(list_concat([n_words - list_sum(counts)], counts), lambda x: x / greatest(n_words, 1.0)) END AS common
  FROM judged j LEFT JOIN counted USING (r)),
sound AS (SELECT * FROM hists WHERE NOT base_failed AND n_chars >= 200 AND n_words >= 60),
class_refs AS (SELECT lang, list(m ORDER BY k) AS ref_classes FROM (SELECT lang, k, avg(classes[k]) AS m FROM sound, range(1, 8) t(k) GROUP BY lang, k) GROUP BY lang),
common_refs AS (
  SELECT lang, list(m ORDER BY k) AS ref_common FROM (SELECT lang, k, avg(common[k]) AS m FROM sound, range(1, 14) t(k) WHERE k <= len(common) GROUP BY lang, k)
  WHERE lang IN (SELECT lang FROM sound GROUP BY lang HAVING count(*) >= 30) GROUP BY lang),
refs AS (SELECT lang, ref_classes, ref_common, list_transform(ref_common, lambda x, k: CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS bare FROM class_refs LEFT JOIN common_refs USING (lang)),
far AS (
  SELECT h.*, CASE WHEN n_chars >= 200 THEN {_DISTANCE.format(p='classes', q='ref_classes')} END AS class_distance,
    CASE WHEN n_words >= 60 THEN {_DISTANCE.format(p='common', q='ref_common')} END AS word_distance,
    least(0.45, 0.9 * {_DISTANCE.format(p='bare', q='ref_common')}) AS word_limit,
    ref_classes IS NULL AS no_classes, ref_common IS NULL OR common IS NULL AS no_common
  FROM hists h LEFT JOIN refs USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (NOT no_classes AND coalesce(class_distance, 0) > 0.28) AND NOT (NOT no_common AND coalesce(word_distance > word_limit, false)) AS kept,
  CASE WHEN NOT no_classes THEN round(class_distance, 6) END AS class_distance, CASE WHEN NOT no_common THEN round(word_distance, 6) END AS word_distance
FROM far
"""

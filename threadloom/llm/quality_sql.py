"""The quality rules' query in DuckDB SQL."""

from __future__ import annotations

from threadloom.llm import quality_rules as q


def _part(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"


def _distance(p: str, r: str) -> str:
    terms = f"list_transform(range(1, len({p}) + 1), lambda i: {_part(f'{p}[i]', f'{r}[i]')} + {_part(f'{r}[i]', f'{p}[i]')})"
    return f"sqrt(greatest(list_sum({terms}) / 2, 0.0))"


_LIMIT = "({0[0]} + {0[1]} / sqrt(n_words::DOUBLE))"

SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), s AS (
    SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}]+') AS l,
           regexp_replace(t, '[\\p{{L}}\\p{{M}}]+', '', 'g') AS bare
    FROM d
), many AS (
    SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang
    HAVING count(*) >= greatest({q.LEAST_DOCUMENTS}, (SELECT ceil(count(lang) / {q.LEAST_SHARE}) FROM d))
), tokens AS (
    SELECT rid, lang, {q.UNIT} // len(l) AS n, unnest(l) AS word FROM s WHERE lang IN (FROM many) AND len(l) >= {q.LEAST_WORDS}
), again AS (
    SELECT lang, word, n * (count(*) - 1) AS n FROM tokens GROUP BY rid, lang, n, word HAVING count(*) > 1
), ranked AS (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, word) AS k FROM again GROUP BY lang, word
), lists AS (
    SELECT lang, list(word ORDER BY word) AS words FROM ranked WHERE k <= {q.WORDS} GROUP BY lang
), bins AS (
    SELECT lang AS ref, unnest(words) AS word FROM lists
), spelled AS (
    SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(l) AS word FROM s) WHERE word IN (SELECT word FROM bins) GROUP BY rid, word
), found AS (
    SELECT s.rid, ref, list(coalesce(n, 0) ORDER BY bins.word) AS found FROM s CROSS JOIN bins LEFT JOIN spelled ON spelled.rid = s.rid AND spelled.word = bins.word GROUP BY s.rid, ref
), spots AS (
    SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:])) AS g FROM s WHERE len(w) >= 3
), grams AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM spots
), covered AS (
    SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM grams WHERE n > 1) GROUP BY rid
), c AS (
    SELECT rid, doc_id, lang, t, l, len(w) AS n_words, length(t) AS chars,
           length(bare) - length(regexp_replace(bare, '[\\x20\\x09-\\x0D]+', '', 'g')) AS spaces,
           length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\\p{{Lo}}]+', '', 'g')) AS lo,
           length(regexp_replace(bare, '[\\x20\\x09-\\x0D]+', '', 'g')) AS others, length(regexp_replace(bare, '[^\\p{{N}}]+', '', 'g')) AS digits,
           length(regexp_replace(bare, '[^.,;:''"?!()-]+', '', 'g')) AS marks, length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words
    FROM s LEFT JOIN covered USING (rid)
), k AS (
    SELECT *, [chars - spaces - others - upper, upper, digits, spaces, marks, others - digits - marks] AS kinds,
           n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed
    FROM c
), each_text AS (
    SELECT lang, t, any_value(list_transform(kinds, lambda x: x * {q.UNIT} // chars)) AS kinds,
           any_value(found) AS found, any_value(len(l)) AS n
    FROM k JOIN found ON found.rid = k.rid AND ref = lang WHERE n_words >= {q.LEAST_WORDS} AND len(l) > 0 GROUP BY lang, t
), spread AS (
    SELECT lang, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v
    FROM (SELECT lang, list_concat(kinds, list_transform(list_append(found, n - list_sum(found)), lambda y: y * {q.UNIT} // n)) AS x FROM each_text)
), means AS (
    SELECT lang, i, sum(v)::DOUBLE / count(*) / {q.UNIT} AS m FROM spread GROUP BY lang, i HAVING count(*) >= {q.LEAST_DOCUMENTS}
), refs AS (
    SELECT lang AS ref, words, list(m ORDER BY i) FILTER (i <= 6) AS ref_kinds, list(m ORDER BY i) FILTER (i > 6) AS ref_words
    FROM means JOIN lists USING (lang) GROUP BY lang, words
), p AS (
    SELECT rid, lang, ref, n_words, len(l) AS n, list_transform(kinds, lambda x: x::DOUBLE / chars) AS kinds, ref_kinds, ref_words, found
    FROM k JOIN found USING (rid) JOIN refs USING (ref) WHERE NOT base_failed
), r AS (
    SELECT *, list_transform(list_append(found, n - list_sum(found)), lambda x: x::DOUBLE / greatest(n, 1)) AS shares FROM p
), distances AS (
    SELECT rid, ref = lang AS own, {_distance("kinds", "ref_kinds")} AS dc, {_distance("shares", "ref_words")} AS dw FROM r
), nearest AS (
    SELECT rid, any_value(dc) FILTER (own) AS own_c, any_value(dw) FILTER (own) AS own_w, min(dc) AS least_c, min(dw) AS least_w FROM distances GROUP BY rid
), judged AS (
    SELECT k.*, CASE WHEN own_c <= {_LIMIT.format(q.CLASS_LIMIT)} THEN own_c
                     WHEN own_c IS NOT NULL OR NOT (2 * (strlen(t) - spaces) > 3 * (chars - spaces) AND 2 * lo > chars - spaces) THEN least_c END AS cd,
           CASE WHEN len(l) = 0 OR own_w IS NULL THEN NULL WHEN own_w <= {_LIMIT.format(q.WORD_LIMIT)} THEN own_w ELSE least_w END AS wd
    FROM k LEFT JOIN nearest USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, (chars - spaces)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {_LIMIT.format(q.CLASS_LIMIT)}, false) AND NOT coalesce(wd > {_LIMIT.format(q.WORD_LIMIT)}, false) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM judged
"""

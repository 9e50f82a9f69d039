"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from tilesieve.llm import license_index

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]))) AS g FROM w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
tops AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
stats AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
                 CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(tops.n, 0) AS top_word,
                 length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper, length(t) - length(replace(t, '!', '')) AS exclaim,
                 len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS no_letter
          FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN tops USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR 2 * upper > word_chars OR 5 * exclaim > n_words OR 2 * n_dup_lines > n_lines
            OR NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words) OR 10 * top_word > 3 * n_words OR 2 * no_letter > n_words) AS kept
FROM judged
"""

REVISITS = r"""
WITH bare AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''),
    '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&]+$', '') AS u FROM pages),
p AS (SELECT page_id, html, page_id % 8 AS way,
             regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(regexp_replace(u, '^[^/?]*', ''), '/+$', '') AS url_key FROM bare),
v AS (SELECT *, page_id * 4 + k AS record_id, 1700000000 + k * 2592000 + page_id % 2592000 AS captured,
             CASE WHEN way = 0 THEN k = 2 WHEN way IN (1, 2) THEN k <= 1 ELSE k = 0 END AS full_,
             CASE WHEN way IN (1, 2) AND k >= 1 THEN 1 ELSE 0 END AS version FROM p, unnest(range(4)) t(k)),
r AS (SELECT *, CASE WHEN way IN (4, 6) OR (way = 7 AND NOT full_) THEN NULL
                     ELSE md5(html || '#' || CASE WHEN way = 3 AND k = 2 THEN 9 WHEN way = 1 AND k = 3 THEN 0 ELSE version END) END AS tag,
             CASE WHEN way = 6 AND k = 3 THEN 'day 2' WHEN way IN (6, 7) THEN 'day 1' END AS modified,
             html || CASE WHEN version = 1 THEN '<!-- 1 -->' ELSE '' END AS body FROM v),
j AS (SELECT a.record_id, max_by(b.record_id, (b.captured, b.record_id)) AS q FROM r a JOIN r b ON a.url_key = b.url_key AND b.full_ AND b.captured <= a.captured WHERE NOT a.full_ GROUP BY a.record_id),
s AS (SELECT a.*, b.record_id AS q, b.tag AS source_tag, b.modified AS source_modified, b.body AS source_body,
             CASE WHEN b.record_id IS NULL THEN 'unmatched'
                  WHEN a.tag IS NOT NULL AND b.tag IS NOT NULL THEN CASE WHEN a.tag = b.tag THEN 'resolved' ELSE 'changed' END
                  WHEN a.modified IS NOT NULL AND b.modified IS NOT NULL THEN CASE WHEN a.modified = b.modified THEN 'resolved' ELSE 'changed' END
                  ELSE 'unchecked' END AS status
      FROM r a LEFT JOIN j ON a.record_id = j.record_id LEFT JOIN r b ON b.record_id = j.q WHERE NOT a.full_),
t AS (SELECT *, status IN ('resolved', 'unchecked') AS ok, CASE WHEN tag IS NOT NULL THEN CASE WHEN way = 5 THEN 'W/' ELSE '' END || '"' || tag || '"' ELSE '"' || source_tag || '"' END AS etag FROM s)
SELECT record_id, page_id, url_key, captured, status, CASE WHEN ok THEN q END AS source_id,
       CASE WHEN ok THEN 'cache-control: max-age=600; content-type: text/html; date: ' || captured || coalesce('; etag: ' || etag, '') || coalesce('; last-modified: ' || source_modified, '') || '; server: origin' ELSE '' END AS headers,
       CASE WHEN ok THEN octet_length(encode(source_body)) END AS body_bytes, CASE WHEN ok THEN md5(source_body) END AS body_md5
FROM t
"""


def license_sql() -> str:
    """The license query over the templates and phrases of its module."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    words = ", ".join(f"({k}, {text(w)}, {i})" for k, (_, t, _) in enumerate(license_index.TEMPLATES) for i, w in enumerate(t.split()))
    names = ", ".join(f"({k}, {text(label)})" for k, (label, *_) in enumerate(license_index.TEMPLATES))
    stands = lambda p: f"contains(joined, {text(f' {p} ')})"
    verified = " ".join(f"WHEN {k} THEN {' AND '.join(map(stands, phrases))}" for k, (*_, phrases) in enumerate(license_index.TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT doc_id, place, {text(label)} AS label FROM w JOIN d USING (doc_id) WHERE " + " AND ".join(f"ws[place + {k + 1}] = {text(x)}" for k, x in enumerate(phrase.split())) for phrase, label in license_index.BASE_PHRASES.items()
    )
    between, lookups, gap = license_index.BETWEEN, license_index.LOOKUPS, license_index.GAP
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{license_index.UPPER}', '{license_index.LOWER}'), '{between}'), lambda x: x <> '') AS ws FROM documents),
j AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS joined FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM d),
tw(t, w, pos) AS (VALUES {words}),
names(t, label) AS (VALUES {names}),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM w WHERE w IN (SELECT w FROM tw) GROUP BY w),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM documents)) / (1 + n)) + 1e-9 AS v FROM df),
tv AS (SELECT DISTINCT t, w, v FROM tw JOIN idf USING (w)),
whole AS (SELECT t, sum(v) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, w) AS r FROM tv) WHERE r <= {lookups} GROUP BY t),
held AS (SELECT DISTINCT doc_id, t, w, v FROM w JOIN tv USING (w)),
looked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY v DESC, w) AS r FROM held) WHERE r <= {lookups}),
own AS (SELECT doc_id, t, sum(v) AS weight FROM looked GROUP BY doc_id, t),
offsets AS (SELECT doc_id, t, w, v, w.place - tw.pos AS o FROM looked JOIN w USING (doc_id, w) JOIN tw USING (t, w)),
cells AS (SELECT DISTINCT doc_id, t, w, v, g, floor((o + g * {gap + 1}) / {2 * (gap + 1)}.0) AS cell FROM offsets, (VALUES (0), (1)) grids(g)),
best AS (SELECT doc_id, t, max(s) AS s FROM (SELECT doc_id, t, g, cell, sum(v) AS s FROM cells GROUP BY ALL) GROUP BY doc_id, t),
more AS (SELECT doc_id, label, round(best.s / whole.weight, 6) AS a FROM best JOIN own USING (doc_id, t) JOIN whole USING (t) JOIN names USING (t) JOIN j USING (doc_id)
         WHERE round(best.s / own.weight, 6) >= {license_index.ALIGNED} AND CASE t {verified} END),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM places GROUP BY doc_id),
base_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
all_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM more) GROUP BY doc_id),
scores AS (SELECT doc_id, max(a) AS a FROM more GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, least(1.0, coalesce(a, 0.0))::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN base_labels b USING (doc_id) LEFT JOIN all_labels al USING (doc_id) LEFT JOIN scores USING (doc_id)
"""


ORACLES = {"op1_quality_rules": QUALITY_RULES, "op3_revisit_resolution": REVISITS, "op5_license_index": license_sql()}

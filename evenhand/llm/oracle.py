"""DuckDB counterparts of the operators' queries, where SQL can express the method."""

from __future__ import annotations

_KEY = r"""
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\d*\.', '')
    || regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END"""
_BARE = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_QUERY = (
    "list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda q: q <> '' AND lower(split_part(q, '=', 1)) NOT IN "
    "('fbclid', 'gclid', 'ref', 'sessionid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term')))"
)
_CANONICAL = _KEY.format(bare=_BARE, query=_QUERY.format(bare=_BARE))

REVISITS = f"""
WITH page AS (
    SELECT page_id, {_CANONICAL} AS url_key, md5(coalesce(html, '')) AS digest,
        strlen(coalesce(html, '')) AS size,
        strftime(DATE '2023-01-01' + CAST(page_id % 300 AS INTEGER), '%Y-%m-%d') AS day,
        1704067200 + page_id AS at_s,
        1704067200 + page_id + 86400 + (page_id * 7919) % 100000 AS again_s
    FROM pages
), asked AS (
    SELECT *, CASE WHEN page_id % 11 = 0 THEN '"changed"' WHEN page_id % 7 <> 0 THEN '"' || substr(digest, 1, 16) || '"' END AS tag,
        CASE WHEN page_id % 11 = 0 THEN '' ELSE 'W/' END AS weak
    FROM page
), found AS (
    SELECT a.*, f.page_id AS refers_to_page, f.digest AS full_digest, f.size AS full_size, f.day AS full_day,
        '"' || substr(f.digest, 1, 16) || '"' AS full_tag
    FROM asked a ASOF LEFT JOIN page f ON a.url_key = f.url_key AND a.again_s > f.at_s
), judged AS (
    SELECT *, CASE WHEN refers_to_page IS NULL THEN 'missing'
        WHEN tag IS NOT NULL THEN CASE WHEN tag = full_tag THEN 'resolved' ELSE 'mismatch' END
        WHEN day = full_day THEN 'resolved' ELSE 'mismatch' END AS verdict
    FROM found
)
SELECT page_id, url_key, again_s AS at_s, refers_to_page, verdict,
    'age: ' || (page_id % 60) || chr(10) || 'cache-control: max-age=600' || chr(10)
    || CASE WHEN verdict = 'resolved' THEN 'content-length: ' || full_size || chr(10) || 'content-type: text/html' || chr(10)
        || 'etag: ' || coalesce(weak || tag, full_tag) || chr(10)
       ELSE 'content-length: 0' || chr(10) || coalesce('etag: ' || weak || tag || chr(10), '') END
    || 'last-modified: ' || day AS headers,
    CASE WHEN verdict = 'resolved' THEN full_digest END AS payload_digest
FROM judged
"""

SIMILAR = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingled AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []
        ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s
    FROM worded
), named AS (
    SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id
    FROM shingled
), classes AS (
    SELECT class_id, n, s FROM named WHERE doc_id = class_id AND n > 0
), grams AS (
    SELECT class_id, n, unnest(s) AS g FROM classes
), links AS (
    SELECT a.class_id AS a, b.class_id AS b
    FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id
    GROUP BY a.class_id, b.class_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(a, b) AS (
    SELECT class_id, class_id FROM classes
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), rooted AS (
    SELECT a AS class_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, n AS n_shingles, named.class_id,
    (SELECT count(*) FROM links WHERE links.a = named.class_id) AS n_links,
    coalesce(component_id, doc_id) AS component_id
FROM named LEFT JOIN rooted ON named.class_id = rooted.class_id
"""

#: Every phrase of up to five words, counted outright.
PHRASES = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), sizes AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS k
), found AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM worded, sizes WHERE len(w) >= k
), counted AS (
    SELECT lang, k, p, count(*) AS f FROM found GROUP BY lang, k, p HAVING count(*) >= 100
), inner_phrases AS (
    SELECT lang, p, max(f) AS f FROM (
        SELECT lang, p[1:k - 1] AS p, f FROM counted WHERE k > 2 UNION ALL SELECT lang, p[2:k] AS p, f FROM counted WHERE k > 2
    ) GROUP BY lang, p
), kept AS (
    SELECT c.* FROM counted c LEFT JOIN inner_phrases i ON i.lang = c.lang AND i.p = c.p WHERE c.k > 1 AND coalesce(i.f, 0) < c.f
), cuts AS (
    SELECT lang, p, f, unnest(range(1, k)) AS cut FROM kept
), scored AS (
    SELECT c.lang, c.p, c.cut, c.f AS a, x.f AS l, y.f AS r, n,
        CAST(CAST(1000 AS HUGEINT) * c.f * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:cut] JOIN counted y ON y.lang = c.lang AND y.p = c.p[cut + 1:]
    JOIN totals t ON t.lang = c.lang
), least AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), named AS (
    SELECT *, array_to_string(p, ' ') AS phrase FROM least
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""

#: Shortest path over the role grammar, row by row; each state holds its cost, its edits and the rows that they leave.
REPAIR = """
WITH RECURSIVE bits AS (
    SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS v, 0 AS n FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8
), crc AS (
    SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8
), given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations
), summed AS (
    SELECT given.*, xor(4294967295, list_reduce(
        list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS kind
    FROM given, crc
), harmed AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM summed WHERE kind <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
    FROM harmed
), marked AS (
    SELECT *, role[1] AS initial,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM numbered
), ids AS (
    SELECT row_number() OVER () AS conv, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
), steps AS (
    SELECT ids.conv, m.* FROM marked m JOIN ids ON ids.conv_id IS NOT DISTINCT FROM m.conv_id
), search AS (
    SELECT conv, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS e, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''} AS s,
        {'c': CAST(2 AS BIGINT), 'a': 'I', 't': 'user:'} AS u, {'c': CAST(4 AS BIGINT), 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS a
    FROM ids
    UNION ALL
    SELECT conv, i, e, s, least(u, {'c': a.c + 2, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'},
            {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'}, {'c': e.c + 2, 'a': e.a || 'I', 't': 'user:'}),
        least(a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'},
            {'c': s.c + 4, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
            {'c': e.c + 4, 'a': e.a || 'II', 't': 'user:' || chr(10) || 'assistant:'})
    FROM (
        SELECT r.conv, p.i, {'c': e.c + 3, 'a': e.a || 'D', 't': e.t} AS e,
            least({'c': s.c + 3, 'a': s.a || 'D', 't': s.t}, {'c': e.c + stays + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'a': e.a || 'K', 't': own}) AS s,
            least({'c': u.c + 3, 'a': u.a || 'D', 't': u.t},
                {'c': a.c + stays + keeps_u, 'a': a.a || CASE keeps_u WHEN 0 THEN 'K' ELSE 'R' END, 't': a.t || chr(10) || as_u},
                {'c': s.c + stays + keeps_u, 'a': s.a || CASE keeps_u WHEN 0 THEN 'K' ELSE 'R' END, 't': s.t || chr(10) || as_u},
                {'c': e.c + stays + keeps_u, 'a': e.a || CASE keeps_u WHEN 0 THEN 'K' ELSE 'R' END, 't': as_u}) AS u,
            least({'c': a.c + 3, 'a': a.a || 'D', 't': a.t},
                {'c': u.c + stays + keeps_a, 'a': u.a || CASE keeps_a WHEN 0 THEN 'K' ELSE 'R' END, 't': u.t || chr(10) || as_a}) AS a
        FROM search r JOIN (
            SELECT conv, i, initial, CASE fault WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 1000000000 END AS stays, role || ':' || text AS own,
                CASE WHEN initial = 'u' THEN 0 ELSE 2 END AS keeps_u, CASE WHEN initial = 'a' THEN 0 ELSE 2 END AS keeps_a,
                CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text AS as_u,
                CASE WHEN initial = 'a' THEN role ELSE 'assistant' END || ':' || text AS as_a
            FROM steps
        ) p ON p.conv = r.conv AND p.i = r.i + 1
    )
), ended AS (
    SELECT conv, least(arg_max(e, i), arg_max(a, i)) AS best FROM search GROUP BY conv
), counted AS (
    SELECT conv, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM steps GROUP BY conv
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM ids JOIN ended ON ended.conv = ids.conv LEFT JOIN counted ON counted.conv = ids.conv
"""

ORACLE = {"op2_revisit_resolution": REVISITS, "op6_trie_jaccard": SIMILAR, "op11_toivonen_phrases": PHRASES, "op12_conversation_repair": REPAIR}

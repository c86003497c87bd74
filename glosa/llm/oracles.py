"""DuckDB SQL for the queries that SQL can express, written apart from the operators:
relational brute force with its own patterns and constants."""

from __future__ import annotations

# --- 1: every window counted --------------------------------------------------------------------

_OP1 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, unnest(range(0, len(h) // 2 - 399)) AS i, h FROM d WHERE len(h) >= 800),
m AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM w),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY m) AS n FROM m) WHERE n > 1),
g AS (SELECT rid, i, i > lag(i, 1, -1000) OVER (PARTITION BY rid ORDER BY i) + 400 AS opens FROM r),
k AS (SELECT rid, i, sum(opens::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM g),
s AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY rid, run),
p AS (SELECT s.rid, run, a, b, substr(h, 2 * lag(b, 1, 0) OVER o + 1, 2 * (a - lag(b, 1, 0) OVER o)) AS piece
      FROM s JOIN d ON d.rid = s.rid WINDOW o AS (PARTITION BY s.rid ORDER BY run)),
t AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY run) AS front, max(b) AS last FROM p GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)"""

# --- 4 -----------------------------------------------------------------------------------------

_OP4_TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_OP4 = r"""
WITH t(license, unit) AS (VALUES TEMPLATE_ROWS),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || floor(doc_id / 100)::BIGINT AS folder,
        regexp_matches(coalesce(text, ''), '^(Licensed under|Released under|This work is licensed under) ') AS lic FROM documents),
l AS (SELECT DISTINCT rid, unit FROM (SELECT rid, unnest(string_split(text, chr(10))) AS unit FROM d)
      WHERE regexp_matches(unit, '(?i)licen[sc]e|copyright|spdx|public domain|permission is hereby|redistribution and use')
      UNION SELECT rid, text FROM d WHERE lic),
u AS (SELECT DISTINCT unit FROM l),
uw AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+([.-][a-z0-9]+)*')) AS word FROM u) GROUP BY 1, 2),
tw AS (SELECT unit AS template, license, word, count(*) AS tf FROM (SELECT license, unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+([.-][a-z0-9]+)*')) AS word FROM t) GROUP BY 1, 2, 3),
n AS (SELECT (SELECT count(*) FROM u) + (SELECT count(*) FROM t) AS n),
i AS (SELECT word, ln((n + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM (SELECT word FROM uw UNION ALL SELECT word FROM tw), n GROUP BY word, n),
ux AS (SELECT unit, word, tf * idf AS w FROM uw JOIN i USING (word)), tx AS (SELECT template, license, word, tf * idf AS w FROM tw JOIN i USING (word)),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM ux GROUP BY unit), tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tx GROUP BY template),
c AS (SELECT ux.unit, tx.template, tx.license, sum(ux.w * tx.w) AS dot FROM ux JOIN tx USING (word) GROUP BY 1, 2, 3),
m AS (SELECT c.unit, license, round(dot / (un.norm * tn.norm), 4) AS cosine FROM c JOIN un USING (unit) JOIN tn USING (template)),
o AS (SELECT rid, license, cosine FROM l JOIN m USING (unit) WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, license) = 1),
f AS (SELECT d.*, o.license, o.cosine FROM d LEFT JOIN o USING (rid)),
s AS (SELECT folder, license, cosine FROM f WHERE lic AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, license) = 1)
SELECT doc_id, f.folder || '/' || CASE WHEN lic THEN 'LICENSE-' || doc_id ELSE 'doc-' || doc_id || '.txt' END AS path,
       coalesce(f.license, s.license) AS license, coalesce(f.cosine, s.cosine) AS cosine,
       CASE WHEN f.license IS NOT NULL THEN CASE WHEN lic THEN 'file' ELSE 'header' END WHEN s.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN f.license IS NULL THEN s.folder END AS from_dir
FROM f LEFT JOIN s ON s.folder = f.folder""".replace("TEMPLATE_ROWS", ", ".join(f"('{a}', '{b}')" for a, b in _OP4_TEMPLATES))

# --- 5: digests straight from the rows, lengths from the template's rule ------------------------

_OP5 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
l AS (SELECT *, length(text) + length(text) - length(translate(text, '\#<', '')) AS t_len,
             length(role) + length(role) - length(translate(role, '\#<:', '')) AS r_len FROM r),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(4 + r_len + 2 + t_len + 8)::BIGINT AS formatted_chars FROM l GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""

# --- 2: positions from the pieces between matches --------------------------------------------

_SECRET_KINDS = [  # kind, pattern, group, least length
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    # a key with its END line, or the BEGIN line alone (a body without an END line is tested in tests/llm/test_secrets.py)
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]*(-{1,4}[^-]+)*-{5,}END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 4),
]


def _op2() -> str:
    found = " UNION ALL ".join(
        f"""SELECT rid, '{k}' AS kind, {i} AS ord, unnest(list_zip(regexp_extract_all(t, '{p}'), regexp_extract_all(t, '{p}', {g}),
                 string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))])) AS z, {least} AS least,
                 unnest(range(len(regexp_extract_all(t, '{p}')))) AS nth FROM d"""
        for i, (k, p, g, least) in enumerate(_SECRET_KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
p AS (SELECT rid, kind, ord, least, length(z[2]) AS glen,
             sum(length(z[1]) + length(z[3])) OVER (PARTITION BY rid, kind ORDER BY nth) AS stop, length(z[1]) AS len FROM f),
s AS (SELECT rid, kind, ord, stop - len AS start, stop FROM p WHERE glen >= least),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""


# --- 3: every rule tried on every address ----------------------------------------------------

_OP3 = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
b AS (SELECT page_id, t, regexp_extract(t, '^([^/?#]*)', 1) AS h0 FROM a),
c AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(t, length(h0) + 1) AS tail FROM b),
p AS (SELECT page_id, host, regexp_extract(tail, '^([^?#]*)', 1) AS path, host || tail AS addr FROM c),
r AS (SELECT *, '.' || host AS dh,
  CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(addr, '/docs/[^?#]*\?([^#]*&)?utm_source=feed([&#]|$)') THEN 'allow'
       WHEN regexp_matches(addr, '[?&]utm_source=feed([&#]|$)') OR regexp_matches(addr, '^([^/?#]*\.)?doubleclick\.net([:/?#]|$)')
         OR regexp_matches(addr, '[?&;](sid|phpsessid|jsessionid)=') OR regexp_matches(addr, '/(login|signin)([/?#.]|$)')
         OR contains(addr, '/ads/') OR regexp_matches(addr, '[?&]print=') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r"""

# --- 6: all pairs of the stated query set -----------------------------------------------------

_OP6 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

# --- 7: all pairs that share a shingle, then reachability -------------------------------------

_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d WHERE r.c < l.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = w.doc_id"""

# --- 9 -----------------------------------------------------------------------------------------

_OP9_TESTED = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, w, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] END AS g
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
u AS (SELECT rid, i, w, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS twice FROM g),
x AS (SELECT rid, w, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rep FROM u),
m AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (rep) AS n_repeat_words FROM x GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT d.rid, doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_words, 0) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * coalesce(n_words, 0) AS base_failed
      FROM d LEFT JOIN m USING (rid) LEFT JOIN l USING (rid))"""

_OP9 = f"""
WITH {_OP9_TESTED},
t AS (SELECT rid, source, unnest(['base', 'symbols', 'dup_lines', 'short_words']) AS rule,
             unnest([base_failed, 10 * n_symbols > word_chars, 10 * n_dup_lines > n_words, word_chars < 2 * n_words]) AS failed FROM b),
h AS (SELECT source AS host, rule, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS f FROM t GROUP BY source, rule),
p AS (SELECT rule, count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(f) AS f, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS pairs, sum(f * f / n) AS f2 FROM h GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND pairs > 0.1
        THEN least(greatest(1 / greatest(((f2 - m * f) / (m * (1 - m)) - (k - 1)) / pairs, 1e-12) - 1, 1.0), 1e6) ELSE 1.0 END AS s FROM p),
j AS (SELECT host, bool_or((f + m * s) / (n + s) > 0.5) AS bad FROM h JOIN q USING (rule) GROUP BY host),
o AS (SELECT rid, bool_or(failed) AS failed FROM t GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT bad AS kept
FROM b JOIN o ON o.rid = b.rid JOIN j ON j.host IS NOT DISTINCT FROM b.source"""

# --- 10: the level of the shares in closed form, then one running sum per source ----------------

_OP10 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (SELECT d.*, -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
                  / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
      FROM d LEFT JOIN q ON q.doc_id = d.doc_id),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS stop FROM s0),
o AS (SELECT *, row_number() OVER (ORDER BY stop / w, source NULLS LAST) AS k, (SELECT sum(source_size) FROM s0) AS total FROM s),
c AS (SELECT *, coalesce(sum(stop) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
lvl AS (SELECT min_by((total - stopped) / rest, k) AS level FROM c WHERE stop / w >= (total - stopped) / rest),
t AS (SELECT source, source_size, least(stop, w * coalesce(level, 0)) AS target FROM s, lvl),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (epochs + (budget > 0 AND so_far + size / 2 <= budget)::INT))::BIGINT AS taken
FROM r"""

# --- 11: every phrase counted by its text ---------------------------------------------------------

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT doc_id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT doc_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT doc_id, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws)),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a, min(doc_id) AS first_doc FROM g GROUP BY ALL HAVING count(*) >= 100),
i AS (SELECT c.lang, c.phrase FROM f c JOIN f b ON b.lang = c.lang AND b.k > c.k AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ')
      WHERE c.k > 1 AND 100 * b.a >= 100 * c.a),
c AS (SELECT * FROM f ANTI JOIN i USING (lang, phrase) WHERE k > 1),
u AS (SELECT c.*, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT u.lang, u.phrase, u.a, u.first_doc, cut, l.a AS l, r.a AS r, n.n,
             (1000::HUGEINT * u.a * n.n // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM u JOIN n ON n.lang = u.lang JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[:cut], ' ')
      JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, first_doc
FROM b QUALIFY rank <= 2000"""

# --- 12: the article element's blocks ---------------------------------------------------------

_OP12 = r"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT rid, unnest(string_split_regex(t, '</?(p|h1)>')) AS block, unnest(range(len(string_split_regex(t, '</?(p|h1)>')))) AS pos FROM a),
s AS (SELECT rid, pos, regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS block FROM b),
e AS (SELECT rid, pos, regexp_replace(replace(replace(replace(block, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS block FROM s),
w AS (SELECT rid, pos, trim(regexp_replace(block, '\s+', ' ', 'g')) AS block FROM e),
t AS (SELECT rid, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM w WHERE block <> '' GROUP BY rid)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM a LEFT JOIN t USING (rid)"""

# --- 13: shortest edits row by row, a step of the recursion for all conversations ----------------

_OP13 = r"""
WITH RECURSIVE
tab AS (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS tab
        FROM (SELECT unnest(range(256)) AS i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::UBIGINT)),
                                  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 20 AS kind FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE kind <> 0),
c AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again,
             NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY cid ORDER BY i) AS r0 FROM o),
n AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
             count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM f GROUP BY cid),
e AS (SELECT cid, i, r, blank OR again AS go, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM f),
-- cheapest (cost, audit) with nothing written, after s, after u, after a; insertions closed at once
p AS (SELECT cid, 0::BIGINT AS i, {'c': 0, 'a': ''} AS e, {'c': 1000000, 'a': ''} AS s, {'c': 5, 'a': 'I'} AS u, {'c': 10, 'a': 'II'} AS a FROM c
  UNION ALL
  SELECT cid, i, e, s, u, list_min([a, {'c': u.c + 5, 'a': u.a || 'I'}]) FROM (
    SELECT cid, i, e, s, a, list_min([u, {'c': e.c + 5, 'a': e.a || 'I'}, {'c': s.c + 5, 'a': s.a || 'I'}, {'c': a.c + 5, 'a': a.a || 'I'}]) AS u FROM (
      SELECT p.cid, x.i, {'c': p.e.c + 2, 'a': p.e.a || 'D'} AS e,
        list_min([{'c': p.s.c + 2, 'a': p.s.a || 'D'}, {'c': CASE WHEN go OR r <> 's' THEN 1000000 ELSE p.e.c + extra END, 'a': p.e.a || 'K'}]) AS s,
        list_min([{'c': p.u.c + 2, 'a': p.u.a || 'D'}] || flatten(list_transform([p.e, p.s, p.a], lambda t: [
           {'c': CASE WHEN go OR r <> 'u' THEN 1000000 ELSE t.c + extra END, 'a': t.a || 'K'}, {'c': CASE WHEN go THEN 1000000 ELSE t.c + extra + 1 END, 'a': t.a || 'R'}]))) AS u,
        list_min([{'c': p.a.c + 2, 'a': p.a.a || 'D'}, {'c': CASE WHEN go OR r <> 'a' THEN 1000000 ELSE p.u.c + extra END, 'a': p.u.a || 'K'},
                  {'c': CASE WHEN go THEN 1000000 ELSE p.u.c + extra + 1 END, 'a': p.u.a || 'R'}]) AS a
      FROM p JOIN e x ON x.cid = p.cid AND x.i = p.i + 1))),
b AS (SELECT p.cid, list_min([p.e, p.a]) AS best FROM p JOIN n ON n.cid = p.cid AND n.rows = p.i),
l AS (SELECT cid, best.a AS audit, unnest(string_split(best.a, '')) AS edit, unnest(range(1, len(best.a) + 1)) AS pos FROM b),
q AS (SELECT cid, edit, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place FROM l WINDOW w AS (PARTITION BY cid ORDER BY pos)),
w AS (SELECT q.cid, place, edit, CASE WHEN edit = 'I' THEN '' ELSE o.text END AS text, CASE WHEN edit = 'K' THEN o.role END AS role FROM q LEFT JOIN o ON o.cid = q.cid AND o.i = q.i WHERE edit <> 'D'),
z AS (SELECT w.*, max((place = 1 AND edit = 'K' AND substr(role, 1, 1) = 's')::INT) OVER (PARTITION BY cid) AS lead FROM w),
t AS (SELECT cid, string_agg(coalesce(role, CASE WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS told FROM z GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM c LEFT JOIN n USING (cid) LEFT JOIN b USING (cid) LEFT JOIN t USING (cid)"""

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": _OP1,
    "op2_secret_scans": _op2(),
    "op3_url_filters": _OP3,
    "op4_license_scans": _OP4,
    "op5_chat_formatting": _OP5,
    "op6_exact_topk": _OP6,
    "op7_minhash_dedup": _OP7,
    "op9_quality_rules": _OP9,
    "op10_mixing": _OP10,
    "op11_phrase_mining": _OP11,
    "op12_html_extraction": _OP12,
    "op13_conversation_repair": _OP13,
}

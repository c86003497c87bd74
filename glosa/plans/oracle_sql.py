"""DuckDB SQL for the correctness oracle.

The oracle re-derives every registered query with plain SQL over the driver
tables, independently of the Spark plan: tokens are unnested into a long
table and neighbours come from ``lag``/``lead`` windows (the Spark side keeps
arrays inside the document row).  Only the token regex, word lists and
class patterns are shared, because they are the contract.
"""

from __future__ import annotations

from glosa.functions import vocab
from glosa.functions.text import EMAIL_REGEX, GAP_TOKEN_REGEX, NATIONALITY_FORMS, URL_TLDS, WORD_END
from glosa.operators import ruler as R
from glosa.operators.spans import IDX_DIGITS, encode_pattern


def q(s: str) -> str:
    """SQL string literal (DuckDB: backslashes are literal)."""
    return "'" + s.replace("'", "''") + "'"


def inlist(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def tokens_ctes(src: str) -> str:
    """CTEs ``t0, t1, tk``: one row per token of ``src(doc_id, text)`` with
    attributes and neighbours."""
    rx = q(GAP_TOKEN_REGEX.replace(WORD_END, r"\b"))  # RE2 has no look-ahead; its \b is ASCII
    nl = "chr(10)"
    shape_raw = (
        "translate(regexp_replace(regexp_replace(regexp_replace(tok, '\\p{Lu}', chr(1), 'g'), "
        "'\\p{L}', chr(2), 'g'), '\\p{Nd}', chr(3), 'g'), chr(1) || chr(2) || chr(3), 'Xxd')"
    )
    core = "lower(regexp_replace(regexp_replace(tok, '^[+\\-±~]', ''), '[,.]', '', 'g'))"
    core_raw = "regexp_replace(regexp_replace(tok, '^[+\\-±~]', ''), '[,.]', '', 'g')"
    tld = "regexp_extract(regexp_extract(tok, '\\.([^.]*)$', 1), '^([^:]*)', 1)"
    return f"""
t0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {rx}, 1) AS gaps,
              regexp_extract_all(coalesce(text, ''), {rx}, 2) AS toks FROM {src}),
t1 AS (SELECT doc_id, unnest(gaps) AS gap, unnest(toks) AS tok, unnest(range(len(toks))) AS i, len(toks) AS n FROM t0),
t2 AS (SELECT doc_id, CAST(i AS INT) AS i, CAST(n AS INT) AS n, tok, lower(tok) AS lw,
         CAST(coalesce(sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS INT) AS tstart,
         {shape_raw} AS shape_raw,
         (regexp_full_match({core_raw}, '\\d+') OR regexp_full_match({core_raw}, '\\d+/\\d+')
           OR {core} IN {inlist(vocab.NUM_WORDS)}) AS lnum,
         regexp_full_match(tok, '\\d+') AS dig,
         regexp_full_match(tok, '\\p{{L}}+') AS alp,
         regexp_full_match(tok, '[\\x00-\\x7F]*') AS asc_,
         regexp_full_match(tok, '\\p{{P}}+') AS pun,
         regexp_matches(tok, {q(EMAIL_REGEX)}) AS email,
         (starts_with(tok, 'http://') OR starts_with(tok, 'https://') OR (starts_with(tok, 'www.') AND length(tok) >= 5)
           OR (contains(tok, '.') AND NOT starts_with(tok, '.') AND NOT ends_with(tok, '.') AND NOT contains(tok, '@')
               AND (ends_with({tld}, '/') OR (regexp_full_match({tld}, '\\p{{L}}+') AND lower({tld}) IN {inlist(URL_TLDS)})))) AS url,
         CASE WHEN tok IN ('.', '!', '?') OR contains(tok, {nl}) THEN 1 ELSE 0 END AS is_end
       FROM t1),
tk AS (SELECT *,
         array_to_string(list_filter(string_split(shape_raw, ''), lambda c, j:
             NOT (j > 4 AND c = string_split(shape_raw, '')[j - 1] AND c = string_split(shape_raw, '')[j - 2]
                  AND c = string_split(shape_raw, '')[j - 3] AND c = string_split(shape_raw, '')[j - 4])), '') AS shp,
         CAST(coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS sid,
         lag(lw, 1) OVER w AS lw_1, lag(lw, 2) OVER w AS lw_2, lag(lw, 3) OVER w AS lw_3, lag(lw, 4) OVER w AS lw_4,
         lag(tok, 1) OVER w AS tok_1, lag(tok, 2) OVER w AS tok_2,
         lead(lw, 1) OVER w AS lw1, lead(lw, 2) OVER w AS lw2,
         lead(tok, 1) OVER w AS tok1, lead(tok, 2) OVER w AS tok2,
         lead(asc_, 1) OVER w AS asc1, lead(lnum, 1) OVER w AS lnum1,
         lead(dig, 1) OVER w AS dig1, lead(dig, 2) OVER w AS dig2
       FROM t2 WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def classes_enc(cls_case: str, src: str = "tk") -> str:
    """Per document: the class string with inline token indices."""
    return (f"SELECT doc_id, string_agg(({cls_case}) || lpad(CAST(i AS VARCHAR), {IDX_DIGITS}, '0'), '' ORDER BY i) AS enc "
            f"FROM {src} GROUP BY doc_id")


def class_spans(enc_rel: str, pattern: str, label: str, prio: int = 0) -> str:
    rx = encode_pattern(pattern)
    return (f"SELECT doc_id, CAST(substr(m, 2, {IDX_DIGITS}) AS INT) AS tok_start, "
            f"CAST(right(m, {IDX_DIGITS}) AS INT) + 1 AS tok_end, {q(label)} AS label, {prio} AS prio "
            f"FROM (SELECT doc_id, unnest(regexp_extract_all(enc, {q(rx)})) AS m FROM {enc_rel})")


# --------------------------------------------------------------------------
# ruler
# --------------------------------------------------------------------------

DATE_CLS = (
    f"CASE WHEN lw IN {inlist(vocab.MONTHS)} THEN 'M' WHEN lw = 'a' THEN 'A' WHEN lw = 'los' THEN 'L' "
    "WHEN lw = 'días' THEN 'D' WHEN lw = 'del' THEN 'l' WHEN lw = 'mes' THEN 'm' WHEN lw = 'de' THEN 'e' "
    f"WHEN lw = 'año' THEN 'Y' WHEN lw IN {inlist(vocab.PREPOSITIONS)} THEN 'p' WHEN lnum THEN 'n' ELSE 'o' END"
)
USER_CLS = "CASE WHEN tok = 'del' THEN 'd' WHEN tok = 'usuario' THEN 'u' WHEN tok = '\"' THEN 'q' WHEN alp THEN 'a' ELSE 'o' END"


def ruler_match_sql(src: str) -> str:
    """All ruler matches ``(doc_id, tok_start, tok_end, label, prio)``."""
    G = R.GROUPS.index
    one = []

    def add(group: str, k: int, cond: str, width: int, label: str) -> None:
        one.append(f"SELECT doc_id, i AS tok_start, i + {width} AS tok_end, {q(label)} AS label, "
                   f"{G(group) * 100 + k} AS prio FROM tk WHERE coalesce({cond}, false)")

    add("dni", 0, f"shp IN {inlist(vocab.DNI_SHAPES)}", 1, "NUM_DNI")
    add("telefonos", 0, f"shp IN {inlist(vocab.PHONE_SHAPES)}", 1, "NUM_TELÉFONO")
    add("ips", 0, f"shp IN {inlist(vocab.IP_SHAPES)}", 1, "NUM_IP")
    add("fecha_numerica", 0, f"shp IN {inlist(vocab.NUMERIC_DATE_SHAPES)}", 1, "FECHA_NUMÉRICA")
    add("cuij", 0, f"tok IN {inlist(vocab.CUIJ_PREFIXES)} AND (asc1 OR lnum1)", 2, "NUM_CUIJ")
    add("nacionalidad", 0, f"lw IN {inlist(NATIONALITY_FORMS)}", 1, "NACIONALIDAD")
    add("patentes", 0, f"shp IN {inlist(vocab.PLATE_SHAPES)}", 1, "PATENTE_DOMINIO")
    add("estudios", 0, f"lw = 'estudios' AND lw1 IN {inlist(vocab.STUDY_LEVELS)} AND lw2 IN {inlist(vocab.STUDY_STATES)}",
        3, "ESTUDIOS")
    add("marcas_autos", 0, f"tok = 'marca' AND lw1 IN {inlist(vocab.CAR_MAKES)}", 2, "MARCA_AUTOMÓVIL")
    for k, mk in enumerate(vocab.CAR_MAKES_TWO_WORDS, start=1):
        a, b = mk.split(" ")
        add("marcas_autos", k, f"tok = 'marca' AND lw1 = {q(a)} AND lw2 = {q(b)}", 3, "MARCA_AUTOMÓVIL")
    add("correo_electronico", 0, "email", 1, "CORREO_ELECTRÓNICO")
    add("ley", 0, "lw = 'ley' AND lnum1", 2, "LEY")
    add("cuit", 0, f"regexp_matches(tok, {q(vocab.CUIT_REGEX)})", 1, "NUM_CUIT_CUIL")
    add("archivos", 0, f"regexp_matches(tok, {q(R.FILE_REGEX)})", 1, "NOMBRE_ARCHIVO")
    add("pasaporte", 0, f"regexp_matches(tok, {q(vocab.PASSPORT_REGEX)})", 1, "PASAPORTE")
    add("link", 0, "url", 1, "LINK")
    add("cbu", 0, "tok = 'CBU' AND dig1 AND length(tok1) = 22", 2, "CBU")
    add("cbu", 1, "tok = 'CBU' AND tok1 = ':' AND dig2 AND length(tok2) = 22", 3, "CBU")
    parts = list(one)
    opt = ["", "[Aelp]"], ["", "n"]
    forms = [(0, "M" + a + n) for a in opt[0] for n in opt[1]]
    forms += [(1, "ALnD" + l + m + "eM" + a + n) for l in ("", "l") for m in ("", "m") for a in opt[0] for n in opt[1]]
    forms += [(2, "n[Aelp]M" + a + y + n) for a in opt[0] for y in ("", "Y") for n in opt[1]]
    for k, form in forms:  # every form at every start
        width = len(form.replace("[Aelp]", "p"))
        parts.append(f"SELECT doc_id, i AS tok_start, i + {width} AS tok_end, 'FECHA' AS label, {G('fecha') * 100 + k} AS prio "
                     f"FROM date_next WHERE regexp_matches(nxt, '^{form}')")
    parts.append(class_spans("user_enc", R.USER_PATTERN, "USUARIX", G("usuarix") * 100))
    bank_rx = R.bank_regex(True)
    parts.append(
        f"SELECT doc_id, CAST(substr(m, 2, {IDX_DIGITS}) AS INT) AS tok_start, "
        f"CAST(regexp_extract(m, {q(chr(1) + '(' + chr(92) + 'd{' + str(IDX_DIGITS) + '})' + chr(2) + '[^' + chr(1) + ']*$')}, 1) AS INT) + 1 AS tok_end, "
        f"'BANCO' AS label, {G('bancos') * 100} AS prio "
        f"FROM (SELECT doc_id, unnest(regexp_extract_all(wenc, {q(bank_rx)})) AS m FROM word_enc)"
    )
    return f"""{tokens_ctes(src)},
date_c AS (SELECT doc_id, i, {DATE_CLS} AS c FROM tk),
date_next AS (SELECT doc_id, i, c || {" || ".join(f"coalesce(lead(c, {k}) OVER w, '')" for k in range(1, 10))} AS nxt
              FROM date_c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
user_enc AS ({classes_enc(USER_CLS)}),
word_enc AS (SELECT doc_id, string_agg(chr(1) || lpad(CAST(i AS VARCHAR), {IDX_DIGITS}, '0') || chr(2)
              || replace(replace(replace(lw, chr(1), ''), chr(2), ''), chr(3), '') || chr(3), '' ORDER BY i) AS wenc
             FROM tk GROUP BY doc_id),
rm AS ({" UNION ALL ".join(parts)})"""


def fold_select(rel: str, order: str, rejected_block: bool, out: str = "sel") -> str:
    """O1 in SQL: per document, fold over spans in ``order`` with ``list_reduce``."""
    st = "STRUCT(tok_start INT, tok_end INT, label VARCHAR, prio BIGINT)"
    cover = "(y.tok_start <= x.tok_start AND x.tok_start < y.tok_end) OR (y.tok_start <= x.tok_end - 1 AND x.tok_end - 1 < y.tok_end)"
    if rejected_block:
        # every span marks; kept = no earlier span covers its first / last token
        return f"""{out}_l AS (SELECT doc_id, list(struct_pack(tok_start := tok_start, tok_end := tok_end, label := label,
                   prio := CAST(prio AS BIGINT)) ORDER BY {order}) AS l FROM {rel} WHERE tok_end > tok_start GROUP BY doc_id),
{out} AS (SELECT doc_id, x.tok_start, x.tok_end, x.label, x.prio FROM (
    SELECT doc_id, unnest(list_filter(l, lambda x, j: len(list_filter(l[1:j - 1], lambda y: {cover})) = 0)) AS x FROM {out}_l))"""
    return f"""{out}_l AS (SELECT doc_id, list(struct_pack(tok_start := tok_start, tok_end := tok_end, label := label,
                   prio := CAST(prio AS BIGINT)) ORDER BY {order}) AS l FROM {rel} WHERE tok_end > tok_start GROUP BY doc_id),
{out} AS (SELECT doc_id, x.tok_start, x.tok_end, x.label, x.prio FROM (
    SELECT doc_id, unnest(list_reduce(l,
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {cover})) > 0 THEN acc ELSE list_concat(acc, [x]) END,
        []::{st}[])) AS x FROM {out}_l))"""

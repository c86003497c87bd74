"""Oracle SQL (DuckDB dialect) for every registered query in
``glosa.plans.queries``; same output columns, computed independently."""

from __future__ import annotations

from glosa.functions import vocab
from glosa.functions.text import (
    ACCUSED_ADVISOR_FORMS,
    JUDGE_FORMS,
    OMBUDS_FORMS,
    PHONE_FORMS,
    PROSECUTOR_FORMS,
    SECRETARY_FORMS,
)
from glosa.operators import sequence as S
from glosa.operators.context import ENTITY_BASE, EXISTING_BASE, IP_REGEX
from glosa.operators.dataset import HASH_MOD, HASH_MUL
from glosa.plans.fixtures import derived_ctes
from glosa.plans.oracle_sql import (
    class_spans,
    classes_enc,
    fold_select,
    inlist,
    q,
    ruler_match_sql,
    tokens_ctes,
)

ROUND = 6


def sql(ctes: list[str], select: str, derived: list[str] = ()) -> str:
    all_ctes = derived_ctes(list(derived)) + [c.strip().rstrip(",") for c in ctes if c.strip()]
    return "WITH " + ",\n".join(all_ctes) + "\n" + select


DOCS = "src AS (SELECT doc_id, text FROM documents)"
RUL = "src AS (SELECT doc_id, text FROM rulings)"


# --------------------------------------------------------------------------
# tokens
# --------------------------------------------------------------------------

TOKENS = sql([DOCS, tokens_ctes("src")], "SELECT doc_id, i, tok AS token, tstart AS char_start FROM tk")

TOKEN_ATTRIBUTES = sql(
    [DOCS, tokens_ctes("src"),
     f"""agg AS (SELECT doc_id, count(*) AS n_tokens, count_if(lnum) AS n_like_num, count_if(dig) AS n_digit,
            count_if(alp) AS n_alpha, count_if(asc_) AS n_ascii, count_if(pun) AS n_punct,
            count_if(email) AS n_like_email, count_if(url) AS n_like_url,
            count_if(lw IN {inlist(vocab.PREPOSITIONS)}) AS n_adp, max(sid) + 1 AS n_sentences,
            count_if(contains(tok, chr(10))) AS n_newlines FROM tk GROUP BY doc_id)"""],
    """SELECT d.doc_id, """ + ", ".join(
        f"CAST(coalesce(a.{c}, 0) AS BIGINT) AS {c}"
        for c in ["n_tokens", "n_like_num", "n_digit", "n_alpha", "n_ascii", "n_punct", "n_like_email",
                  "n_like_url", "n_adp", "n_sentences", "n_newlines"]
    ) + " FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id",
)

SHAPES = sql([DOCS, tokens_ctes("src")], "SELECT shp AS shape, count(*) AS n FROM tk GROUP BY shp")

# --------------------------------------------------------------------------
# ruler / matchers / rules
# --------------------------------------------------------------------------

RULER_MATCHES_RULINGS = sql([RUL, ruler_match_sql("src")],
                            "SELECT DISTINCT doc_id, tok_start, tok_end, label FROM rm", ["rulings"])
RULER_MATCHES_DOCUMENTS = sql([DOCS, ruler_match_sql("src")],
                              "SELECT DISTINCT doc_id, tok_start, tok_end, label FROM rm")

_OVERLAP = "s.doc_id = b.doc_id AND s.tok_start < b.tok_end AND s.tok_end > b.tok_start"

def _r20_ctes(src_cte: str, base: str = "base_spans") -> list[str]:
    return [
        src_cte, ruler_match_sql("src"),
        fold_select("rm", "(tok_end - tok_start) DESC, tok_start DESC, prio", rejected_block=False, out="rsel"),
        f"""ents0 AS (SELECT doc_id, tok_start, tok_end, label FROM {base} b
                      WHERE NOT EXISTS (SELECT 1 FROM rsel s WHERE {_OVERLAP})
                   UNION ALL SELECT doc_id, tok_start, tok_end, label FROM rsel)""",
    ]


R20_CTES = [
    RUL, ruler_match_sql("src"),
    fold_select("rm", "(tok_end - tok_start) DESC, tok_start DESC, prio", rejected_block=False, out="rsel"),
    f"""ents0 AS (SELECT doc_id, tok_start, tok_end, label FROM base_spans b
                  WHERE NOT EXISTS (SELECT 1 FROM rsel s WHERE {_OVERLAP})
               UNION ALL SELECT doc_id, tok_start, tok_end, label FROM rsel)""",
]
RULER_OVERWRITE = sql(R20_CTES, "SELECT doc_id, tok_start, tok_end, label FROM ents0", ["rulings", "base_spans"])

NUM_CLS = f"CASE WHEN lw IN {inlist(vocab.NUM_WORDS)} THEN 'N' WHEN tok = 'y' THEN 'y' WHEN dig THEN 'D' ELSE 'o' END"
NUM_CTES = [
    f"""ncls AS (SELECT doc_id, i, {NUM_CLS} AS c FROM tk)""",
    """nstr AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS s FROM ncls GROUP BY doc_id)""",
    """nm AS (SELECT doc_id, CAST(i AS INT) AS tok_start, CAST(i + CASE c WHEN 'D' THEN 1 ELSE
             length(regexp_extract(substr(s, i + 1), '^(N+y*N+y*N+y*N+|N+)', 1)) END AS INT) AS tok_end, 'NUM' AS label, 0 AS prio
             FROM ncls JOIN nstr USING (doc_id) WHERE c IN ('N', 'D'))""",
    fold_select("nm", "(tok_end - tok_start) DESC, tok_start, prio", rejected_block=True, out="nc0"),
    f"""nc AS (SELECT c.doc_id, c.tok_start, c.tok_end, c.label FROM nc0 c JOIN tk t ON t.doc_id = c.doc_id AND t.i = c.tok_start
            WHERE NOT (coalesce(t.tok_1 IN {inlist(vocab.PAGE_FIRST_LEFT)}, false)
                    OR coalesce(t.tok_2 IN {inlist(vocab.PAGE_SECOND_LEFT)}, false)
                    OR coalesce(t.tok1 IN {inlist(vocab.MEASURE_FIRST_RIGHT)}, false)))""",
]
NUM_CANDIDATES = sql([DOCS, tokens_ctes("src")] + NUM_CTES, "SELECT doc_id, tok_start, tok_end, label FROM nc")
NUM_CANDIDATES_RULINGS = sql([RUL, tokens_ctes("src")] + NUM_CTES, "SELECT doc_id, tok_start, tok_end, label FROM nc",
                             ["rulings"])

M4_CTES = R20_CTES + NUM_CTES + [
    """ents1 AS (SELECT * FROM ents0 UNION ALL
                SELECT * FROM nc b WHERE NOT EXISTS (SELECT 1 FROM ents0 s WHERE s.doc_id = b.doc_id
                   AND s.tok_start < b.tok_end AND s.tok_end > b.tok_start))"""
]
NUM_STAGE = sql(M4_CTES, "SELECT doc_id, tok_start, tok_end, label FROM ents1", ["rulings", "base_spans"])

ART_CLS = (f"CASE WHEN lw IN {inlist(vocab.ARTICLE_WORDS)} THEN 'A' WHEN tok = ',' THEN ',' WHEN dig THEN 'D' "
           "WHEN tok = 'y' THEN 'y' WHEN pun THEN 'P' ELSE 'o' END")
VIO_CLS = (f"CASE WHEN lw IN {inlist(vocab.VIOLENCE_WORDS)} THEN 'V' WHEN lw IN {inlist(vocab.GENDER_VIOLENCE_TYPES)} THEN 'G' "
           f"WHEN lw IN {inlist(vocab.VIOLENCE_TYPES)} THEN 'T' WHEN tok = 'de' THEN 'e' WHEN tok = ',' THEN ',' "
           "WHEN tok = 'y' THEN 'y' WHEN pun THEN 'P' ELSE 'o' END")
MATCH_CTES = [
    f"art_enc AS ({classes_enc(ART_CLS)})",
    f"vio_enc AS ({classes_enc(VIO_CLS)})",
    f"am AS ({class_spans('art_enc', S.ARTICLE_PATTERN, 'ARTÍCULO')})",
    f"""vm AS ({class_spans('vio_enc', S.GENDER_VIOLENCE_PATTERN, vocab.LABEL_GENDER_VIOLENCE, 0)}
             UNION ALL {class_spans('vio_enc', S.VIOLENCE_PATTERN, vocab.LABEL_VIOLENCE, 1)})""",
]
ARTICLE_VIOLENCE = sql([RUL, tokens_ctes("src")] + MATCH_CTES,
                       "SELECT doc_id, tok_start, tok_end, label FROM am UNION ALL SELECT doc_id, tok_start, tok_end, label FROM vm",
                       ["rulings"])

TOKEN_RULES_CTES = [
    "edad_s AS (SELECT DISTINCT doc_id, sid FROM tk WHERE contains(tok, 'edad'))",
    f"""tr AS (
  SELECT doc_id, i AS tok_start, i + 1 AS tok_end, 'NUM_CAUSA' AS label, CAST(i AS BIGINT) * 8 + 0 AS prio FROM tk
   WHERE i >= 3 AND coalesce(lnum, false) AND (coalesce(lw_1 = 'nº' AND lw_2 = 'causa', false) OR coalesce(lw_1 = 'caso', false))
  UNION ALL
  SELECT tk.doc_id, i, i + 1, 'EDAD', CAST(i AS BIGINT) * 8 + 1 FROM tk JOIN edad_s e ON e.doc_id = tk.doc_id AND e.sid = tk.sid
   WHERE i <> n - 1 AND coalesce(lnum, false) AND coalesce(tok1 = 'años', false)
  UNION ALL
  SELECT doc_id, i, i + 1, 'NUM_CUIJ', CAST(i AS BIGINT) * 8 + 2 FROM tk
   WHERE i >= 3 AND (coalesce(asc_, false) OR coalesce(lnum, false)) AND coalesce(lw_3 = 'cuij', false)
  UNION ALL
  SELECT doc_id, i, i + 1, 'NUM_ACTUACIÓN', CAST(i AS BIGINT) * 8 + 3 FROM tk
   WHERE i >= 3 AND coalesce(lw_1 = ':' AND lw_2 = 'nro' AND lw_3 = 'actuación', false)
  UNION ALL
  SELECT doc_id, i, i + 1, 'NUM_EXPEDIENTE', CAST(i AS BIGINT) * 8 + 4 FROM tk
   WHERE i >= 3 AND (coalesce(lw_1 = 'nº' AND (lw_3 = 'expediente' OR lw_2 = 'expediente'), false)
                     OR (coalesce(lnum, false) AND coalesce(lw_2 = 'expediente', false)))
  UNION ALL
  SELECT doc_id, i - 1, i + 1, 'LOC', CAST(i AS BIGINT) * 8 + 5 FROM tk
   WHERE i >= 3 AND coalesce(lw_1 IN {inlist(vocab.PLACE_LEFT)}, false))""",
]
TOKEN_RULES = sql([RUL, tokens_ctes("src")] + TOKEN_RULES_CTES, "SELECT doc_id, tok_start, tok_end, label FROM tr",
                  ["rulings"])


def _at(arr: str, idx: str) -> str:
    """0-based array access, NULL off the edge (DuckDB lists are 1-based and wrap on negatives)."""
    return f"(CASE WHEN ({idx}) >= 0 THEN {arr}[({idx}) + 1] END)"


def _in(arr: str, idx: str, words: list[str]) -> str:
    return f"coalesce({_at(arr, idx)} IN {inlist(words)}, false)"


def _any_left(idx: str, words: list[str], ks=(1, 2, 3)) -> str:
    return "(" + " OR ".join(_in("a.lws", f"{idx} - {k}", words) for k in ks) + ")"


def _entity_rules_sql() -> str:
    first, second = vocab.ADDRESS_FIRST_LEFT, vocab.ADDRESS_SECOND_LEFT
    s, e = "x.tok_start", "x.tok_end"

    def L(k):
        return _at("a.lws", f"{s} - {k}")

    def inn(k, words):
        return _in("a.lws", f"{s} - {k}", words)

    lnum_e = f"coalesce({_at('a.lnums', e)}, false)"
    per_addr = f"(x.label = 'PER' AND ({inn(1, first)} OR {inn(2, second)} OR coalesce({_at('a.lnums', f'{e} - 1')}, false) OR {lnum_e}))"
    num_addr = (f"(x.label = 'NUM' AND ({inn(1, first)} OR {inn(2, first)} OR {inn(2, second)} OR {inn(3, first)} "
                f"OR {inn(3, second)} OR {inn(4, first)} OR {inn(4, second)}))")
    ext = (f"CASE WHEN x.label = 'PER' AND {lnum_e} THEN 1 WHEN x.label <> 'NUM' THEN 0 "
           f"WHEN {inn(1, first)} THEN 1 WHEN {inn(2, first)} OR {inn(2, second)} THEN 2 WHEN {inn(3, first)} THEN 3 "
           f"WHEN {inn(3, second)} THEN (CASE WHEN coalesce({L(2)} = 'en', false) THEN 1 ELSE 0 END) "
           f"WHEN {inn(4, first)} THEN 4 "
           f"WHEN {inn(4, second)} THEN (CASE WHEN coalesce({L(3)} = 'en', false) THEN 2 ELSE 0 END) ELSE 0 END")
    per_loc = "x.label IN ('PER', 'LOC')"
    guard = f"{s} >= 3"
    tl = f"({_at('a.tstarts', f'{e} - 1')} + length({_at('a.toks', f'{e} - 1')}) - {_at('a.tstarts', s)})"
    left, right = f"length({L(1)})", f"length({_at('a.lws', f'{s} + 1')})"
    plate_s = (f"CASE WHEN {tl} <> 3 THEN {s} WHEN {left} = 3 THEN {s} - 1 WHEN {left} = 2 AND {right} = 2 THEN {s} - 1 "
               f"WHEN {right} = 3 THEN {s} END")
    plate_e = (f"CASE WHEN {tl} <> 3 THEN {e} WHEN {left} = 3 THEN {e} WHEN {left} = 2 AND {right} = 2 THEN {e} + 1 "
               f"WHEN {right} = 3 THEN {e} + 1 END")
    plate_c = f"coalesce({_at('a.lnums', s)}, false) AND {_any_left(s, vocab.PLATE_LEFT)}"
    phone = (f"x.label = 'NUM' AND ({_any_left(s, PHONE_FORMS)} OR {_in('a.toks', f'{s} - 1', vocab.PHONE_TEXTS)} "
             f"OR {_in('a.toks', f'{s} - 2', vocab.PHONE_TEXTS)} "
             f"OR coalesce({_at('a.toks', f'{s} - 1')} = '(' AND {_at('a.toks', f'{s} + 1')} = ')', false))")
    rules = [
        (1, "LEY", f"{guard} AND x.label = 'NUM' AND {_any_left(s, vocab.LAW_LEFT)}", s, e),
        (2, "PERIODO", f"{s} <> a.n - 1 AND x.label = 'NUM' AND {_in('a.toks', e, vocab.PERIOD_WORDS)}", s, f"{e} + 1"),
        (3, "JUEZX", f"{guard} AND {per_loc} AND {_any_left(s, JUDGE_FORMS)}", s, e),
        (4, "SECRETARIX", f"{guard} AND {per_loc} AND {_any_left(s, SECRETARY_FORMS)}", s, e),
        (5, "FISCAL", f"{guard} AND {per_loc} AND {_any_left(s, PROSECUTOR_FORMS)}", s, e),
        (6, "DEFENSORX", f"{guard} AND {per_loc} AND {_any_left(s, OMBUDS_FORMS)}", s, e),
        (7, "NUM_IP", f"{guard} AND x.label IN ('NUM', 'NUM_IP') AND {e} = {s} + 1 AND coalesce(regexp_matches({_at('a.toks', s)}, {q(IP_REGEX)}), false)", s, e),
        (8, "NUM_TELÉFONO", f"{guard} AND {phone}", s, e),
        (9, "PER", f"{guard} AND {per_loc} AND {_any_left(s, ACCUSED_ADVISOR_FORMS)}", s, e),
        (10, "DIRECCIÓN", f"{guard} AND ({per_addr} OR {num_addr})", f"{s} - ({ext})", e),
        (11, "PATENTE_DOMINIO", f"{guard} AND {plate_c} AND ({plate_s}) IS NOT NULL", f"({plate_s})", f"({plate_e})"),
    ]
    parts = [
        f"SELECT x.doc_id, CAST({st} AS INT) AS tok_start, CAST({en} AS INT) AS tok_end, '{lab}' AS label, "
        f"{ENTITY_BASE} + CAST(x.j AS BIGINT) * 16 + {k} AS prio FROM ex x JOIN arrs a ON a.doc_id = x.doc_id WHERE {cond}"
        for k, lab, cond, st, en in rules
    ]
    parts.append(
        f"SELECT doc_id, tok_start, tok_end, 'FECHA_RESOLUCION', {ENTITY_BASE} + CAST(j AS BIGINT) * 16 FROM ("
        "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok_start) AS r FROM ex "
        "WHERE label = 'FECHA' AND tok_start >= 3 AND tok_start < 100) WHERE r = 1"
    )
    return " UNION ALL ".join(parts)


ANNOTATE_CTES = M4_CTES + MATCH_CTES + [
    fold_select("am", "(tok_end - tok_start) DESC, tok_start, prio", rejected_block=True, out="amsel"),
    """ents2 AS (SELECT doc_id, tok_start, tok_end, label FROM amsel UNION ALL
                SELECT * FROM ents1 b WHERE NOT EXISTS (SELECT 1 FROM amsel s WHERE s.doc_id = b.doc_id
                   AND s.tok_start < b.tok_end AND s.tok_end > b.tok_start))""",
    fold_select("vm", "(tok_end - tok_start) DESC, tok_start, prio", rejected_block=True, out="vmsel"),
    """ents3 AS (SELECT doc_id, tok_start, tok_end, label FROM vmsel UNION ALL
                SELECT * FROM ents2 b WHERE NOT EXISTS (SELECT 1 FROM vmsel s WHERE s.doc_id = b.doc_id
                   AND s.tok_start < b.tok_end AND s.tok_end > b.tok_start))""",
    "ex AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok_start) - 1 AS j FROM ents3)",
    """arrs AS (SELECT doc_id, max(n) AS n, list(lw ORDER BY i) AS lws, list(tok ORDER BY i) AS toks,
                      list(lnum ORDER BY i) AS lnums, list(tstart ORDER BY i) AS tstarts FROM tk GROUP BY doc_id)""",
] + TOKEN_RULES_CTES + [
    f"er AS ({_entity_rules_sql()})",
    f"""kept_existing AS (SELECT x.doc_id, x.tok_start, x.tok_end, x.label, {EXISTING_BASE} + x.j AS prio
        FROM ex x JOIN arrs a ON a.doc_id = x.doc_id
        WHERE NOT (x.tok_start >= 3 AND x.label = 'PATENTE_DOMINIO' AND coalesce(contains({_at('a.lws', 'x.tok_start')}, 'bis'), false)
                   AND NOT {_any_left('x.tok_start', vocab.PLATE_LEFT)}))""",
    "cand AS (SELECT * FROM tr UNION ALL SELECT * FROM er UNION ALL SELECT * FROM kept_existing)",
    fold_select("cand", "(tok_end - tok_start) DESC, tok_start, prio", rejected_block=True, out="fin"),
]
ANNOTATE_SELECT = """SELECT f.doc_id, f.tok_start, f.tok_end, f.label,
       a.tstarts[f.tok_start + 1] AS char_start,
       a.tstarts[f.tok_end] + length(a.toks[f.tok_end]) AS char_end
FROM fin f JOIN arrs a ON a.doc_id = f.doc_id"""
ANNOTATE_RULINGS = sql(ANNOTATE_CTES, ANNOTATE_SELECT, ["rulings", "base_spans"])
_NO_BASE = "no_base AS (SELECT CAST(NULL AS BIGINT) AS doc_id, 0 AS tok_start, 0 AS tok_end, 'x' AS label WHERE false)"
ANNOTATE_DOCUMENTS = sql([_NO_BASE] + _r20_ctes(DOCS, "no_base") + ANNOTATE_CTES[len(R20_CTES):], ANNOTATE_SELECT)

# --------------------------------------------------------------------------
# dataset
# --------------------------------------------------------------------------

LABEL_FILTER = sql([], "SELECT doc_id, ann_start, ann_end + 1 AS ann_end, label FROM raw_ann WHERE label IN ('PER', 'LOC')",
                   ["raw_ann"])


def _w1(rel: str, key: str, order: str, out: str) -> str:
    st = "STRUCT(s INT, e INT, label VARCHAR)"
    cover = "(y.s <= x.s AND x.s < y.e) OR (y.s <= x.e - 1 AND x.e - 1 < y.e)"
    return f"""{out}_l AS (SELECT {key}, list(struct_pack(s := CAST(ann_start AS INT), e := CAST(ann_end AS INT), label := label)
                 ORDER BY {order}) AS l FROM {rel} GROUP BY {key}),
{out} AS (SELECT {key}, x.s AS ann_start, x.e + 1 AS ann_end, x.label FROM (
    SELECT {key}, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {cover})) > 0 THEN acc
                                                        ELSE list_concat(acc, [x]) END, []::{st}[])) AS x FROM {out}_l))"""


W1_CTE = _w1("raw_ann", "doc_id", "(ann_end - ann_start) DESC, ann_start, ann_end, label", "w1")
OVERLAP_RESOLUTION = sql([W1_CTE], "SELECT doc_id, ann_start, ann_end, label FROM w1", ["raw_ann"])
LABEL_COUNTS = sql([W1_CTE], "SELECT label, count(*) AS n FROM w1 GROUP BY label", ["raw_ann"])
PER_LABEL_COUNTS = sql(
    [_w1("raw_ann", "doc_id, label", "(ann_end - ann_start) DESC, ann_start, ann_end", "w1l")],
    "SELECT v.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES ('PER'), ('LOC'), ('DIRECCIÓN'), ('FECHA')) v(label) "
    "LEFT JOIN (SELECT label, count(*) AS n FROM w1l GROUP BY label) c ON c.label = v.label",
    ["raw_ann"],
)
OVERLAP_COUNTS = sql([W1_CTE], "SELECT CAST((SELECT count(*) FROM w1) AS BIGINT) AS kept, "
                               "CAST((SELECT count(*) FROM raw_ann) - (SELECT count(*) FROM w1) AS BIGINT) AS overlapped",
                     ["raw_ann"])
LABEL_VOCABULARY = sql([W1_CTE], "SELECT DISTINCT label FROM w1", ["raw_ann"])


def _rank(seed: int) -> str:
    return (f"rk AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * {HASH_MUL} + {seed}) % {HASH_MOD}, doc_id) AS rk "
            f"FROM rulings)")


BATCHES_FIXED = sql([_rank(1)], "SELECT doc_id, CAST(rk AS BIGINT) AS rk, CAST(floor((rk - 1) / 4) AS INT) AS batch FROM rk",
                    ["rulings"])


# 6, 9, then 12 for good
_COMPOUNDING = "CASE WHEN rk <= 6 THEN 0 WHEN rk <= 15 THEN 1 ELSE 2 + CAST(floor((rk - 16) / 12) AS INT) END"
BATCHES_COMPOUNDING = sql([_rank(1)], f"SELECT doc_id, CAST(rk AS BIGINT) AS rk, CAST({_COMPOUNDING} AS INT) AS batch FROM rk",
                          ["rulings"])
SAMPLE = sql([], f"SELECT doc_id FROM rulings ORDER BY (doc_id * {HASH_MUL} + 7) % {HASH_MOD}, doc_id LIMIT 100",
             ["rulings"])
TRAIN_VALIDATION = sql([], "SELECT label, count(*) AS n FROM gold GROUP BY label", ["gold"])

# --------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------

MATCHED = """m AS (SELECT doc_id, tok_start, tok_end, label, g.doc_id IS NOT NULL AS in_gold, p.doc_id IS NOT NULL AS in_pred
      FROM (SELECT *, doc_id AS gd FROM gold) g FULL OUTER JOIN (SELECT * FROM pred) p USING (doc_id, tok_start, tok_end, label))"""
MATCHED = """m AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.tok_start, p.tok_start) AS tok_start,
                  coalesce(g.tok_end, p.tok_end) AS tok_end, coalesce(g.label, p.label) AS label,
                  g.doc_id IS NOT NULL AS in_gold, p.doc_id IS NOT NULL AS in_pred
      FROM gold g FULL OUTER JOIN pred p ON g.doc_id = p.doc_id AND g.tok_start = p.tok_start
           AND g.tok_end = p.tok_end AND g.label = p.label)"""
MATCHED_SPANS = sql([MATCHED], "SELECT * FROM m", ["gold", "pred"])
DOC_COUNTS = """dc AS (SELECT o.o_orderkey AS doc_id, CAST(coalesce(c.tp, 0) AS BIGINT) AS tp, CAST(coalesce(c.fp, 0) AS BIGINT) AS fp,
                   CAST(coalesce(c.fn, 0) AS BIGINT) AS fn
      FROM orders o LEFT JOIN (SELECT doc_id, count_if(in_gold AND in_pred) AS tp, count_if(in_pred AND NOT in_gold) AS fp,
                                      count_if(in_gold AND NOT in_pred) AS fn FROM m GROUP BY doc_id) c ON c.doc_id = o.o_orderkey),
ds AS (SELECT doc_id, tp, fp, fn,
              tp / (tp + fp + 1e-100) AS p, tp / (tp + fn + 1e-100) AS r FROM dc),
ds2 AS (SELECT doc_id, tp, fp, fn, p * 100 AS ents_p, r * 100 AS ents_r, 2.0 * p * r / (p + r + 1e-100) * 100 AS ents_f FROM ds)"""
DOC_SCORES = sql([MATCHED, DOC_COUNTS],
                 f"SELECT doc_id, tp, fp, fn, round(ents_p, {ROUND}) AS ents_p, round(ents_r, {ROUND}) AS ents_r, "
                 f"round(ents_f, {ROUND}) AS ents_f FROM ds2", ["gold", "pred"])
MACRO_SCORES = sql([MATCHED, DOC_COUNTS],
                   f"SELECT count(*) AS n_docs, round(avg(ents_p), {ROUND}) AS precision, round(avg(ents_r), {ROUND}) AS recall, "
                   f"round(avg(ents_f), {ROUND}) AS f_score FROM ds2", ["gold", "pred"])
PER_LABEL_SCORES = sql(
    [MATCHED,
     """lc AS (SELECT doc_id, label, CAST(count_if(in_gold AND in_pred) AS DOUBLE) AS tp, CAST(count_if(in_pred AND NOT in_gold) AS DOUBLE) AS fp,
                     CAST(count_if(in_gold AND NOT in_pred) AS DOUBLE) AS fn FROM m GROUP BY doc_id, label),
        lf AS (SELECT label, tp / (tp + fp + 1e-100) AS p, tp / (tp + fn + 1e-100) AS r FROM lc)"""],
    f"SELECT label, round(sum(2.0 * p * r / (p + r + 1e-100) * 100) / (SELECT count(*) FROM orders), {ROUND}) AS f_score "
    f"FROM lf GROUP BY label", ["gold", "pred"])

# --------------------------------------------------------------------------
# history
# --------------------------------------------------------------------------

SAVE_EVENTS = sql([], """SELECT session, epoch, val_f_score,
       coalesce(max(val_f_score) OVER (PARTITION BY session ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before,
       val_f_score >= 80.0 AND val_f_score > coalesce(max(val_f_score) OVER (PARTITION BY session ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS saved
FROM history""", ["history"])


def _fold_lr(n: str, lr0: float = 0.05, step: float = 0.001) -> str:
    return (f"list_reduce(list_transform(range(CAST({n} AS BIGINT)), lambda x: CAST({step!r} AS DOUBLE)), "
            f"lambda acc, x: acc - x, CAST({lr0!r} AS DOUBLE))")


PLATEAU_CTES = [
    """p0 AS (SELECT *, coalesce(epoch > 3 AND (val_f_score - lag(val_f_score, 3) OVER w) / 3 < 1.0
                          AND NOT ((val_f_score - lag(val_f_score, 1) OVER w) > 0), false) AS cand
          FROM history WINDOW w AS (PARTITION BY session ORDER BY epoch))""",
    """p1 AS (SELECT *, coalesce(sum(CAST(cand AS INT)) OVER (PARTITION BY session ORDER BY epoch
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cprev FROM p0)""",
    f"p2 AS (SELECT *, cand AND {_fold_lr('cprev')} > CAST(0.001 AS DOUBLE) AS plateau FROM p1)",
    f"""p3 AS (SELECT *, {_fold_lr('coalesce(sum(CAST(plateau AS INT)) OVER (PARTITION BY session ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS lr,
                     20 + sum(CAST(plateau AS INT)) OVER (PARTITION BY session ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS planned_epochs
          FROM p2)""",
]
PLATEAU = sql(PLATEAU_CTES, "SELECT session, epoch, plateau, round(lr, 9) AS lr, planned_epochs FROM p3", ["history"])
STOP_CTE = """st AS (SELECT session, min(epoch) AS stop_epoch FROM (
    SELECT session, epoch, coalesce(epoch > 10 AND (val_f_score - lag(val_f_score, 10) OVER w) < 2.0
                                    AND NOT ((val_f_score - lag(val_f_score, 1) OVER w) > 0), false) AS s
    FROM history WINDOW w AS (PARTITION BY session ORDER BY epoch)) WHERE s GROUP BY session)"""
EARLY_STOP = sql([STOP_CTE], "SELECT session, stop_epoch FROM st", ["history"])
BEST_SCORES = sql([STOP_CTE], """SELECT h.session, min(ner) AS min_ner, max(f_score) AS max_f_score, max(recall) AS max_recall,
       max(precision) AS max_precision, max(val_f_score) AS max_val_f_score, max(val_recall) AS max_val_recall,
       max(val_precision) AS max_val_precision
FROM history h LEFT JOIN st ON st.session = h.session
WHERE st.stop_epoch IS NULL OR h.epoch <= st.stop_epoch GROUP BY h.session""", ["history"])
EPOCH_REPORT = sql(PLATEAU_CTES, "SELECT session, epoch, planned_epochs, batches, ner, f_score, precision, val_f_score, val_precision FROM p3",
                   ["history"])
EPOCH_SUMMARY = sql([], f"SELECT session, count(*) AS epochs_run, sum(batches) AS batches, round(avg(batches), {ROUND}) AS batches_per_epoch "
                        "FROM history GROUP BY session", ["history"])

# --------------------------------------------------------------------------
# audit
# --------------------------------------------------------------------------

AUDIT_CTES = [RUL, tokens_ctes("src"),
              """tk2 AS (SELECT *, tstart + length(tok) AS tend FROM tk)""",
              """an AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, char_end, label) - 1 AS ord FROM ann)""",
              """al AS (SELECT an.*, s.i AS st, e.i AS et FROM an
                        LEFT JOIN tk2 s ON s.doc_id = an.doc_id AND s.tstart = an.char_start
                        LEFT JOIN tk2 e ON e.doc_id = an.doc_id AND e.tend = an.char_end)""",
              """cov AS (SELECT t.doc_id, t.i, arg_max(CASE WHEN al.st = al.et THEN 'U-' || al.label WHEN t.i = al.st THEN 'B-' || al.label
                                 WHEN t.i = al.et THEN 'L-' || al.label ELSE 'I-' || al.label END, al.ord) AS tag
                         FROM tk2 t JOIN al ON al.doc_id = t.doc_id AND al.st IS NOT NULL AND al.et IS NOT NULL
                              AND al.st <= t.i AND t.i <= al.et GROUP BY t.doc_id, t.i)""",
              """tags AS (SELECT t.doc_id, t.i, t.tok, coalesce(c.tag, CASE WHEN EXISTS (SELECT 1 FROM an WHERE an.doc_id = t.doc_id
                                 AND t.tstart < an.char_end AND t.tend > an.char_start) THEN '-' ELSE 'O' END) AS tag
                          FROM tk2 t LEFT JOIN cov c ON c.doc_id = t.doc_id AND c.i = t.i)""",
              """mis AS (SELECT DISTINCT doc_id FROM tags WHERE tag = '-')""",
              """runs0 AS (SELECT doc_id, i, tok, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM tags WHERE tag = '-')""",
              """runs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS INT) AS k,
                                replace(string_agg(tok, '' ORDER BY i), ' ', '') AS run_text FROM runs0 GROUP BY doc_id, g)""",
              """fl AS (SELECT r.doc_id, an.char_start, an.char_end, an.label,
                              substr(r.text, an.char_start + 1, an.char_end - an.char_start) AS ann_text,
                              EXISTS (SELECT 1 FROM runs WHERE runs.doc_id = an.doc_id
                                      AND contains(runs.run_text, replace(substr(r.text, an.char_start + 1, an.char_end - an.char_start), ' ', ''))) AS flag
                       FROM an JOIN rulings r ON r.doc_id = an.doc_id)"""]
BILUO_DECODE = sql(AUDIT_CTES, "SELECT doc_id, st AS tok_start, et + 1 AS tok_end, label FROM al WHERE st IS NOT NULL AND et IS NOT NULL",
                   ["rulings", "ann"])
BILUO = sql(AUDIT_CTES, "SELECT doc_id, i, tag FROM tags WHERE tag <> 'O'", ["rulings", "ann"])
MISALIGNED_DOCS = sql(AUDIT_CTES, "SELECT doc_id FROM mis", ["rulings", "ann"])
MISALIGNED_RUNS = sql(AUDIT_CTES, "SELECT doc_id, k, run_text FROM runs", ["rulings", "ann"])
MISALIGNED_ANNOTATIONS = sql(AUDIT_CTES, "SELECT doc_id, char_start, char_end, label, ann_text FROM fl WHERE flag",
                             ["rulings", "ann"])
CLEAN_ANNOTATIONS = sql(AUDIT_CTES, "SELECT doc_id, char_start, char_end, label FROM fl WHERE NOT flag", ["rulings", "ann"])
MISALIGNED_REPORT = sql(AUDIT_CTES, """SELECT r.doc_id, substr(r.text, 1, 700) AS text,
       coalesce((SELECT string_agg(char_start || '|' || char_end || '|' || label || '|' || ann_text, ';' ORDER BY char_start, char_end, label)
                 FROM fl WHERE fl.doc_id = r.doc_id AND flag), '') AS annotations,
       CAST((SELECT count(*) FROM runs WHERE runs.doc_id = r.doc_id) AS BIGINT) AS n_runs
FROM rulings r JOIN mis ON mis.doc_id = r.doc_id""", ["rulings", "ann"])
MISALIGNMENT_SUMMARY = sql(AUDIT_CTES + [
    """sm AS (SELECT (SELECT count(*) FROM rulings) AS n_docs, (SELECT count(*) FROM mis) AS misaligned_docs,
                   (SELECT count(*) FROM an WHERE doc_id IN (SELECT doc_id FROM mis)) AS lost_sum,
                   (SELECT count(*) FROM runs) AS misaligned_runs, (SELECT count(*) FROM fl WHERE flag) AS flagged)"""],
    """SELECT CAST(n_docs AS BIGINT) AS n_docs, CAST(misaligned_docs AS BIGINT) AS misaligned_docs,
       round(100.0 * misaligned_docs / greatest(n_docs, 1), 2) AS misaligned_pct,
       CAST(greatest(lost_sum, 1) AS BIGINT) AS total_lost,
       CAST(misaligned_runs AS BIGINT) AS misaligned_runs,
       round(misaligned_runs / greatest(lost_sum, 1) * 100, 2) AS runs_pct,
       CAST(flagged AS BIGINT) AS flagged_annotations FROM sm""", ["rulings", "ann"])
CLEANUP_SUMMARY = sql(AUDIT_CTES + [
    """sm AS (SELECT (SELECT count(*) FROM rulings) AS n_docs, (SELECT count(*) FROM mis) AS misaligned_docs,
                   (SELECT count(*) FROM fl WHERE NOT flag AND doc_id IN (SELECT doc_id FROM mis)) AS lost_sum,
                   (SELECT count(*) FROM runs) AS misaligned_runs, (SELECT count(*) FROM fl WHERE flag) AS flagged)"""],
    """SELECT CAST(n_docs AS BIGINT) AS n_docs, CAST(misaligned_docs AS BIGINT) AS misaligned_docs,
       round(100.0 * misaligned_docs / greatest(n_docs, 1), 2) AS misaligned_pct,
       CAST(greatest(lost_sum, 1) AS BIGINT) AS total_lost,
       CAST(misaligned_runs AS BIGINT) AS misaligned_runs,
       round(flagged / greatest(lost_sum, 1) * 100, 2) AS removed_pct,
       CAST(flagged AS BIGINT) AS flagged_annotations FROM sm""", ["rulings", "ann"])
#: Where the annotated spans are, in every document: what a tagger should find.
TAGGER_SPANS = sql([RUL, tokens_ctes("src")], """SELECT a.doc_id, CAST(s.i AS INT) AS tok_start, CAST(e.i + 1 AS INT) AS tok_end, a.label
FROM (SELECT doc_id, CASE WHEN label = 'FECHA' THEN 14 ELSE char_start END AS char_start, char_end, label FROM ann) a
JOIN tk s ON s.doc_id = a.doc_id AND s.tstart = a.char_start JOIN tk e ON e.doc_id = a.doc_id AND e.tstart + length(e.tok) = a.char_end""", ["rulings", "ann"])
LOST_BY_LABEL = sql(AUDIT_CTES, "SELECT label, count(*) AS n FROM an WHERE doc_id IN (SELECT doc_id FROM mis) GROUP BY label",
                    ["rulings", "ann"])
_WS, _NWS = "[ \\t\\n\\x0B\\f\\r]", "[^ \\t\\n\\x0B\\f\\r]"
CONCORDANCE = sql([], f"""SELECT a.doc_id, a.char_start, a.char_end,
       substr(r.text, a.char_start + 1, a.char_end - a.char_start) AS ann_text,
       regexp_extract(substr(r.text, 1, a.char_start), {q('((?:' + _NWS + '+' + _WS + '+){0,2})$')}, 1)
         || substr(r.text, a.char_start + 1, a.char_end - a.char_start)
         || regexp_extract(substr(r.text, a.char_end + 1), {q('^(' + _WS + '*(?:' + _NWS + '+' + _WS + '*){0,2})')}, 1) AS context
FROM ann a JOIN rulings r ON r.doc_id = a.doc_id WHERE a.label = 'FECHA'""", ["rulings", "ann"])

ORACLES = {
    "tokens": TOKENS,
    "token_attributes": TOKEN_ATTRIBUTES,
    "shapes": SHAPES,
    "ruler_matches_rulings": RULER_MATCHES_RULINGS,
    "ruler_matches_documents": RULER_MATCHES_DOCUMENTS,
    "ruler_overwrite": RULER_OVERWRITE,
    "num_candidates": NUM_CANDIDATES,
    "num_candidates_rulings": NUM_CANDIDATES_RULINGS,
    "num_stage": NUM_STAGE,
    "article_violence_matches": ARTICLE_VIOLENCE,
    "token_rules": TOKEN_RULES,
    "annotate_rulings": ANNOTATE_RULINGS,
    "annotate_documents": ANNOTATE_DOCUMENTS,
    "convert_json_lines": OVERLAP_RESOLUTION,
    "annotate_stream": ANNOTATE_DOCUMENTS,
    "tagger_spans": TAGGER_SPANS,
    "label_filter": LABEL_FILTER,
    "overlap_resolution": OVERLAP_RESOLUTION,
    "label_counts": LABEL_COUNTS,
    "per_label_counts": PER_LABEL_COUNTS,
    "overlap_counts": OVERLAP_COUNTS,
    "label_vocabulary": LABEL_VOCABULARY,
    "batches_fixed": BATCHES_FIXED,
    "batches_compounding": BATCHES_COMPOUNDING,
    "sample": SAMPLE,
    "train_validation": TRAIN_VALIDATION,
    "matched_spans": MATCHED_SPANS,
    "doc_scores": DOC_SCORES,
    "macro_scores": MACRO_SCORES,
    "per_label_scores": PER_LABEL_SCORES,
    "save_events": SAVE_EVENTS,
    "plateau": PLATEAU,
    "early_stop": EARLY_STOP,
    "best_scores": BEST_SCORES,
    "epoch_report": EPOCH_REPORT,
    "epoch_summary": EPOCH_SUMMARY,
    "biluo": BILUO,
    "biluo_decode": BILUO_DECODE,
    "misaligned_docs": MISALIGNED_DOCS,
    "misaligned_runs": MISALIGNED_RUNS,
    "misaligned_annotations": MISALIGNED_ANNOTATIONS,
    "clean_annotations": CLEAN_ANNOTATIONS,
    "misaligned_report": MISALIGNED_REPORT,
    "misalignment_summary": MISALIGNMENT_SUMMARY,
    "cleanup_summary": CLEANUP_SUMMARY,
    "lost_by_label": LOST_BY_LABEL,
    "concordance": CONCORDANCE,
}

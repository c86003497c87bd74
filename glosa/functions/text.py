"""Tokenizer and token attributes (F3-F16) as per-document array columns.

A document stays ONE row from scan to output: the tokenizer turns ``text``
into an ``array<string>`` and every token attribute is a parallel array
built with higher-order functions, so neighbour access (``nbor(k)``) is an
array lookup instead of a window over an exploded token table.  Nothing in
this module shuffles; per-document state is bounded by the document itself.

The token regex is written so that Java regex (Spark) and RE2 (DuckDB, used
as the oracle) produce the same tokens: explicit character classes instead
of ``\\w``/``\\s``/``\\b``, no look-behind, no back-references.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from glosa.functions import vocab

W = r"[\p{L}\p{N}_]"  # word character, same meaning in Java and RE2
WS = r"[ \t\n\x0B\f\r]"  # whitespace
GAP = r"[ \t\x0B\f\r]"  # whitespace that never forms a token
NWS = r"[^ \t\n\x0B\f\r]"

# No ASCII word character follows (what ``\b`` means after one where it is ASCII only).
WORD_END = r"(?![A-Za-z0-9_])"

_FILE_EXT_ALT = "|".join(sorted(vocab.FILE_EXTENSIONS, key=len, reverse=True))

TOKEN_ALTERNATIVES = [
    # e-mail address
    r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)+",
    # link
    rf"https?://{NWS}+",
    # abbreviations that keep their dot
    r"(?:[Aa]v|[Pp]ág|[Pp]|[Ss]ra|[Ss]r|[Dd]ra|[Dd]r|EE|UU)\.",
    # file name with a known extension
    rf"{W}+(?:-{W}+)*\.(?:{_FILE_EXT_ALT}){WORD_END}",
    # anything holding a digit: 15612/20, 32.481.145, 174bis, J-01-00001234-1/2020-0
    rf"(?:{W}+-)?{W}*\d{W}*(?:[.,/:-]{W}*\d{W}*)*(?:\.-)?",
    # words ("-de" is one token)
    rf"-?{W}+(?:-{W}+)*",
    # one punctuation mark
    r"[^\p{L}\p{N}_ \t\n\x0B\f\r]",
    # a newline (with at most one whitespace on each side) is a token
    rf"{WS}?\n{WS}?",
]
TOKEN_REGEX = "(?:" + "|".join(TOKEN_ALTERNATIVES) + ")"
# group 1 = whitespace gap before the token, group 2 = the token.
GAP_TOKEN_REGEX = f"({GAP}*?)({TOKEN_REGEX})"

# The same matches for Java alone, most tokens by their first test: what stands right behind a plain word, a plain
# number, a mark or a full stop says that no longer alternative can match there.
FAST_ALTERNATIVES = [
    r"[\p{L}_]++(?![\p{N}.+\-@:])",
    r"[^\p{L}\p{N}_ \t\n\x0B\f\r.+\-]",
    r"\.(?![^ \t\n\x0B\f\r])",
    r"\d++(?![\p{L}\p{N}_.,/:+\-@])",
]
FAST_GAP_TOKEN_REGEX = rf"((?:{GAP}(?!\n))*+)(" + "|".join(FAST_ALTERNATIVES) + f"|{TOKEN_REGEX})"

SENTENCE_END = [".", "!", "?"]

# Common top-level domains for LIKE_URL (our contract; a short list by design).
URL_TLDS = [
    "com", "org", "net", "edu", "gov", "gob", "int", "mil", "info", "biz", "io", "ar", "es", "uy",
    "cl", "mx", "br", "co", "pe", "bo", "py", "ve", "ec", "us", "uk", "fr", "de", "it", "pt",
]

EMAIL_REGEX = r"^[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+"


def keep(c: Column) -> Column:
    """Materialise an array column once per row.

    Catalyst inlines a projected expression into its consumer when it is
    referenced once -- also when that single reference sits inside a lambda,
    where it is then re-evaluated per element (quadratic for per-token
    lambdas), and filters are pushed through projections by substituting the
    expression.  A cheap non-deterministic guard (the partition id) stops
    both, so each per-document array is computed exactly once."""
    return F.when(F.spark_partition_id() >= 0, c)


def sql_string(s: str) -> str:
    """Quote a Python string as a Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --------------------------------------------------------------------------
# linear prefix sums (the one primitive Spark SQL arrays lack)
# --------------------------------------------------------------------------


def list_items(a: pa.Array) -> list[list]:
    """The lists of a column; its items are read at once and not one by one (absent lists are empty)."""
    flat = pc.list_flatten(a)
    items = flat.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(flat.type) or not flat.null_count else flat.to_pylist()
    ends = np.cumsum(pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
    return [items[i:j] for i, j in zip([0, *ends], ends)]


def starts_of(text: str, toks: list[str]) -> list[int]:
    """Where each token starts: between tokens stands white space in which the next one cannot begin."""
    out, at = [], 0
    for t in toks:
        at = text.find(t, at)
        out.append(at)
        at += len(t)
    return out


WALK_BYTES = 1 << 22  # of text laid out at once


def _laid_out(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin and end in them."""
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset: text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def flat_starts(text: pa.Array, toks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens of all rows start, their lengths, and where each row's begin in these (a position more than rows).

    Tokens but newlines hold no white space and leave out nothing else, so the k-th other character of a text is the k-th of
    its tokens: positions are looked up, and only texts with newline tokens are walked."""
    flat = pc.list_flatten(toks)
    lens = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(pc.list_value_length(toks).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    starts, before = np.zeros(len(lens), np.int64), np.concatenate([[0], np.cumsum(lens)])
    if not len(lens):
        return starts, lens, rows
    data, at = _laid_out(pc.fill_null(text, ""))
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + WALK_BYTES, "right")) - 1)
        chunk, ends = data[at[i]: at[j]], at[i: j + 1] - at[i]
        lead = (chunk & 0xC0) != 0x80
        solid = lead & (chunk != 32) & ((chunk < 9) | (chunk > 13))
        chars, solids = (np.concatenate([[0], np.cumsum(c)]) for c in (lead, solid))
        where = chars[:-1][solid]
        own = slice(rows[i], rows[j])
        doc = np.repeat(np.arange(j - i), np.diff(rows[i: j + 1]))
        tokens = before[rows[i: j + 1]]
        plain = np.diff(tokens) == np.diff(solids[ends])
        k = solids[ends[:-1]][doc] + before[:-1][own] - tokens[:-1][doc]
        ok = plain[doc]
        starts[own][ok] = where[k[ok]] - chars[ends[:-1]][doc[ok]]
        for r in i + np.flatnonzero(~plain):
            starts[rows[r]: rows[r + 1]] = starts_of(text[int(r)].as_py(), flat[rows[r]: rows[r + 1]].to_pylist())
        i = j
    return starts, lens, rows


@F.arrow_udf(ArrayType(IntegerType()))
def token_starts(text: pa.Array, toks: pa.Array) -> pa.Array:
    starts, _, rows = flat_starts(text, toks)
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(starts, pa.int32()))


@F.arrow_udf(ArrayType(IntegerType()))
def exclusive_cumsum(a: pa.Array) -> pa.Array:
    """Per-row exclusive prefix sum of an ``array<int>``; vectorised over the Arrow batch."""
    lens = pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(a).to_numpy(zero_copy_only=False).astype(np.int64)
    cs = np.cumsum(flat) - flat
    first = np.cumsum(lens) - lens
    base = np.zeros(len(lens), dtype=np.int64)
    nz = lens > 0
    base[nz] = cs[first[nz]]
    out = (cs - np.repeat(base, lens)).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, type=pa.int32()), mask=a.is_null())


# --------------------------------------------------------------------------
# scalar token functions (Column -> Column), usable inside transform()
# --------------------------------------------------------------------------


def shape(t: Column, compat: bool = True) -> Column:
    """F4 SHAPE: upper -> X, other letters -> x, digits -> d, the rest kept;
    runs of one shape character are cut at four when ``compat`` (D3)."""
    s = F.regexp_replace(t, r"\p{Lu}", "\u0001")
    s = F.regexp_replace(s, r"\p{L}", "\u0002")
    s = F.regexp_replace(s, r"\p{Nd}", "\u0003")
    s = F.translate(s, "\u0001\u0002\u0003", "Xxd")
    if compat:
        s = F.regexp_replace(s, r"(?s)(.)\1{4,}", "$1$1$1$1")
    return s


def like_num(t: Column) -> Column:
    """F6 LIKE_NUM: optional sign stripped, ``,``/``.`` dropped; digits,
    digits/digits, or a number word."""
    core = F.regexp_replace(F.regexp_replace(t, r"^[+\-±~]", ""), r"[,.]", "")
    return core.rlike(r"^\d+$") | core.rlike(r"^\d+/\d+$") | isin(F.lower(core), vocab.NUM_WORDS)


def _word_like_num(lw: Column) -> Column:
    """LIKE_NUM of a lower-cased token without digits: only the number words."""
    core = F.when(lw.rlike(r"^[+\-±~]"), F.substring(lw, 2, 1 << 30)).otherwise(lw)
    return isin(F.translate(core, ",.", ""), vocab.NUM_WORDS)


def isin(c: Column, values: list[str]) -> Column:
    """``c IN values`` built with one JVM call (instead of one per literal)."""
    from pyspark.sql.classic.column import Column as JColumn

    return JColumn(c._jc.isInCollection(list(values)))


def is_digit(t: Column) -> Column:
    return t.rlike(r"^\d+$")


def is_alpha(t: Column) -> Column:
    return t.rlike(r"^\p{L}+$")


def is_ascii(t: Column) -> Column:
    """All characters ASCII <=> the UTF-8 byte length equals the character length."""
    return F.octet_length(t) == F.length(t)


def is_punct(t: Column) -> Column:
    return t.rlike(r"^\p{P}+$")


def like_email(t: Column) -> Column:
    return t.rlike(EMAIL_REGEX)


def like_url(t: Column) -> Column:
    """F9 LIKE_URL: scheme or www. prefix, or a dotted token whose last part is
    a known top-level domain or ends with '/'."""
    tld = F.regexp_extract(t, r"\.([^.]*)$", 1)
    tld = F.regexp_extract(tld, r"^([^:]*)", 1)
    dotted = (
        t.contains(".")
        & ~t.startswith(".")
        & ~t.endswith(".")
        & ~t.contains("@")
        & (tld.endswith("/") | (tld.rlike(r"^\p{L}+$") & isin(F.lower(tld), URL_TLDS)))
    )
    return (
        t.startswith("http://")
        | t.startswith("https://")
        | (t.startswith("www.") & (F.length(t) >= 5))
        | dotted
    )


def is_adp(lw: Column) -> Column:
    """F11 POS = ADP, closed list of prepositions (stands in for a tagger)."""
    return isin(lw, vocab.PREPOSITIONS)


# --------------------------------------------------------------------------
# lemma dictionary (F10): surface forms generated from lemmas by rule
# --------------------------------------------------------------------------

_ACCENT_STRIP = str.maketrans("áéíóú", "aeiou")


def lemma_forms(lemmas: list[str]) -> list[str]:
    """Lower-cased surface forms whose lemma is in ``lemmas``: gender and
    number inflection of Spanish nouns/adjectives, generated by rule."""
    out: list[str] = []

    def add(w: str) -> None:
        if w not in out:
            out.append(w)

    for lem in lemmas:
        w = lem.lower()
        add(w)
        if w.endswith("o"):
            stem = w[:-1]
            for suf in ("a", "os", "as"):
                add(stem + suf)
        elif w.endswith("a"):
            add(w + "s")
        elif w.endswith("e"):
            add(w + "s")
        elif w.endswith(("és", "án", "ón", "ín")):
            stem = w[:-2] + w[-2].translate(_ACCENT_STRIP) + w[-1]
            for suf in ("a", "es", "as"):
                add(stem + suf)
        elif w.endswith("í"):
            for suf in ("es", "s"):
                add(w + suf)
        elif w.endswith("z"):
            add(w[:-1] + "ces")
            add(w + "a")
            add(w + "as")
        elif w.endswith(("or", "ol")):
            for suf in ("a", "es", "as"):
                add(w + suf)
        elif w[-1:].isalpha():
            add(w + "es")
    return out


NATIONALITY_FORMS = lemma_forms(vocab.NATIONALITIES)
JUDGE_FORMS = lemma_forms(vocab.JUDGE_LEMMAS)
SECRETARY_FORMS = lemma_forms(vocab.SECRETARY_LEMMAS)
PROSECUTOR_FORMS = lemma_forms(vocab.PROSECUTOR_LEMMAS)
OMBUDS_FORMS = lemma_forms(vocab.OMBUDS_LEMMAS)
ACCUSED_ADVISOR_FORMS = lemma_forms(vocab.ACCUSED_LEMMAS + vocab.ADVISOR_LEMMAS)
PHONE_FORMS = lemma_forms(vocab.PHONE_LEMMAS)


# --------------------------------------------------------------------------
# word-list membership as per-token bit masks
# --------------------------------------------------------------------------

# lists compared with the lower-cased token ...
LOWER_SETS = {
    "num_words": vocab.NUM_WORDS,
    "months": vocab.MONTHS,
    "adp": vocab.PREPOSITIONS,
    "nationality": NATIONALITY_FORMS,
    "study_levels": vocab.STUDY_LEVELS,
    "study_states": vocab.STUDY_STATES,
    "car_makes": vocab.CAR_MAKES,
    "article": vocab.ARTICLE_WORDS,
    "violence": vocab.VIOLENCE_WORDS,
    "gender_types": vocab.GENDER_VIOLENCE_TYPES,
    "violence_types": vocab.VIOLENCE_TYPES,
    "law": vocab.LAW_LEFT,
    "address_first": vocab.ADDRESS_FIRST_LEFT,
    "address_second": vocab.ADDRESS_SECOND_LEFT,
    "plate_left": vocab.PLATE_LEFT,
    "place_left": vocab.PLACE_LEFT,
    "judge": JUDGE_FORMS,
    "secretary": SECRETARY_FORMS,
    "prosecutor": PROSECUTOR_FORMS,
    "ombuds": OMBUDS_FORMS,
    "accused_advisor": ACCUSED_ADVISOR_FORMS,
    "phone_lemma": PHONE_FORMS,
}
# ... and lists compared with the exact token text.
TEXT_SETS = {
    "page_first": vocab.PAGE_FIRST_LEFT,
    "page_second": vocab.PAGE_SECOND_LEFT,
    "measure": vocab.MEASURE_FIRST_RIGHT,
    "phone_text": vocab.PHONE_TEXTS,
    "period": vocab.PERIOD_WORDS,
    "cuij_prefix": vocab.CUIJ_PREFIXES,
}


def _mask_sql(arr: str, sets: dict[str, list[str]]) -> str:
    terms = " + ".join(
        f"(CASE WHEN w IN ({', '.join(sql_string(x) for x in words)}) THEN {1 << k} ELSE 0 END)"
        for k, words in enumerate(sets.values())
    )
    union = sorted({w for words in sets.values() for w in words})
    # most tokens are in no list: one hash lookup in the union decides that
    guard = f"w IN ({', '.join(sql_string(x) for x in union)})"
    return f"transform({arr}, w -> CASE WHEN {guard} THEN CAST({terms} AS BIGINT) ELSE CAST(0 AS BIGINT) END)"


def doc_has(name: str) -> Column:
    """The document holds at least one token of word list ``name``."""
    if name in LOWER_SETS:
        arr, bit = "lmask", 1 << list(LOWER_SETS).index(name)
    else:
        arr, bit = "tmask", 1 << list(TEXT_SETS).index(name)
    return F.exists(arr, lambda m: m.bitwiseAND(F.lit(bit)) != 0)


def candidates(pre) -> Column:
    """Indices of the tokens for which ``pre(t, i)`` holds (a cheap superset
    test run before the full rule conditions)."""
    return F.filter(F.transform("toks", lambda t, i: F.when(pre(t, i), i)), lambda x: x.isNotNull())


def in_set(name: str, i: Column, k: int = 0) -> Column:
    """Token ``i + k`` belongs to word list ``name`` (false off the document edge)."""
    if name in LOWER_SETS:
        arr, bit = "lmask", 1 << list(LOWER_SETS).index(name)
    else:
        arr, bit = "tmask", 1 << list(TEXT_SETS).index(name)
    m = F.get(F.col(arr), i + k) if k else F.get(F.col(arr), i)
    return F.coalesce(m.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


# --------------------------------------------------------------------------
# the token frame
# --------------------------------------------------------------------------

TOKEN_COLUMNS = ["toks", "n", "tstart", "lw", "shp", "lnum", "dig", "alp", "asc", "pun", "sid"]


def token_offsets(text_col: str = "text", when: Column | None = None) -> Column:
    """Char offset of every token, found by one walk over text and tokens.  With ``when``, rows
    where it is false get an empty array and neither is handed to the walk."""
    text, toks = F.coalesce(F.col(text_col), F.lit("")), F.col("toks")
    if when is not None:
        text, toks = F.when(when, text).otherwise(""), F.when(when, toks).otherwise(F.array().cast("array<string>"))
    return token_starts(text, toks)


def is_sentence_end(t: Column) -> Column:
    return isin(t, SENTENCE_END) | t.contains("\n")


def sentence_ends() -> Column:
    """Positions of the sentence-final tokens (F12): a sentence ends after
    ``.``, ``!``, ``?`` or a newline token."""
    return F.filter(F.transform("toks", lambda t, j: F.when(is_sentence_end(t), j)), lambda x: x.isNotNull())


def sentence_ids() -> Column:
    """F12 per token: number of sentence ends before it (a prefix sum)."""
    return exclusive_cumsum(F.transform("toks", lambda t: F.when(is_sentence_end(t), 1).otherwise(0)))


def token_frame(df: DataFrame, text_col: str = "text", compat: bool = True, offsets: bool = True,
                sentences: bool = False) -> DataFrame:
    """Add the per-document token arrays to ``df``.

    toks   token texts                     n      number of tokens
    tstart char offset of each token       lw     lower-cased tokens
    shp    SHAPE (tokens holding a digit)  lnum   LIKE_NUM      hd  holds a digit
    dig    IS_DIGIT   alp IS_ALPHA   asc IS_ASCII   pun IS_PUNCT
    ends   positions of sentence-final tokens (F12); ``sid`` (sentence number
           of each token) only with ``sentences=True``
    lmask / tmask  word-list membership bits of the lower-cased / exact token
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("toks", keep(F.regexp_extract_all(text, F.lit(FAST_GAP_TOKEN_REGEX), 2)))
    if offsets:
        out = out.withColumn("tstart", keep(token_offsets(text_col)))
    out = (
        out.withColumn("n", F.size("toks"))
        .withColumn("hd", keep(F.transform("toks", lambda t: t.rlike(r"\d"))))
        .withColumn("lw", keep(F.transform("toks", F.lower)))
    )
    # SHAPE only for tokens holding a digit: every shape pattern holds one.
    out = (
        out.withColumn("shp", keep(F.transform("toks", lambda t, i: F.when(F.get(F.col("hd"), i), shape(t, compat)))))
        .withColumn("lnum", keep(F.transform("toks", lambda t, i: F.when(F.get(F.col("hd"), i), like_num(t))
                                             .otherwise(_word_like_num(F.get(F.col("lw"), i))))))
        .withColumn("dig", keep(F.transform("toks", lambda t, i: F.get(F.col("hd"), i) & is_digit(t))))
        .withColumn("alp", keep(F.transform("toks", lambda t, i: ~F.get(F.col("hd"), i) & is_alpha(t))))
        .withColumn("asc", keep(F.transform("toks", is_ascii)))
        .withColumn("pun", keep(F.transform("toks", lambda t, i: ~F.get(F.col("hd"), i) & is_punct(t))))
        .withColumn("ends", keep(sentence_ends()))
        .withColumn("lmask", keep(F.expr(_mask_sql("lw", LOWER_SETS))))
        .withColumn("tmask", keep(F.expr(_mask_sql("toks", TEXT_SETS))))
    )
    if sentences:
        out = out.withColumn("sid", keep(sentence_ids()))
    return out


def nb(arr: str, i: Column, k: int = 0) -> Column:
    """Token attribute ``arr`` at position ``i + k`` (NULL off the document edge, D4)."""
    return F.get(F.col(arr), i + k) if k else F.get(F.col(arr), i)


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), 0)


def true(c: Column) -> Column:
    """NULL-safe truth: a condition on a missing neighbour is false."""
    return F.coalesce(c, F.lit(False))

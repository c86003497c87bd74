"""Derived tables built from the driver tables with SQL that runs unchanged
in Spark and in DuckDB (the oracle).

``rulings``      court-ruling text per order (the driver prose holds no
                 Spanish legal vocabulary, so rule fixtures are derived)
``base_spans``   PER / LOC spans standing in for a statistical model
``gold``/``pred`` span tables for scoring
``raw_ann``      raw annotations with inclusive ends, overlapping on purpose
``ann``          char-offset annotations over ``rulings`` (every fifth
                 document shifted by one char to force misalignment)
``history``      per-epoch metric history from ``events``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosa.functions import vocab
from glosa.session import register_tables

PREFIX_TOKENS = 18  # tokens before the branch sentence of every ruling

MONTH_CASE = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {i + 1} THEN '{m}'"
    for i, m in enumerate(
        ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
         "noviembre", "diciembre"]
    )
) + " END"

BRANCHES = [
    "Imputado con prisión de tres años según artículos 20, 21 y 22 de la ley 23737.",
    "Contexto de violencia física y sexual, víctima de violencia de género.",
    "Domicilio sito en Vieytes 1690, expediente nº 123/19, banco macro.",
    "Vehículo marca Fiat, patente AAA 410, a 30 metros, inciso 4.",
    "El imputado tiene 21 años de edad y nacionalidad argentina.",
    "Cuenta con CBU: 0140323501111111500292 y CUIT 20-32481145-7, DNI 32.481.145.",
    "Escribió a luis@mail.com desde 200.111.111.111, archivo carta.docx y https://www.example.com/ .",
    "Llamó al teléfono 4123-4123 el 03/07/2021, pasaporte ABC123456.",
    "Seguido por cuatrocientos noventa y tres millones quinientos pesos, causa nº 3121/27.",
    'Un allanamiento en paraje YPF con estudios secundarios completos, del usuario "juan".',
    "A los 3 días del mes de julio de 2020 la medida (174bis CPP).",
    "Intervino la jueza Ana Gómez junto al secretario Luis Pérez y al fiscal Juan Díaz.",
    "El defensor Pablo Ruiz y la asesora Eva Sosa asistieron a la imputada Rosa Vera, "
    "domiciliada en Moreno 1234, teléfono 4567-8901.",
    # date ranges, several forms on shared tokens
    "Desde el 3 de mayo al 4 de junio de 2020 y del 15 de mayo del 2021 1 a junio 4, mayo de, julio.",
    "A los 12 días del mes de agosto de 2019 al 3 de marzo y el 1 de abril año 2020 7.",
    # chains of two to six joined numbers
    "Sumó uno y dos, uno y dos y tres, uno y dos y tres y cuatro pesos.",
    "Sumó uno y dos y tres y cuatro y cinco, mil cien y dos y tres y seis y siete y ocho metros.",
    # missing space after a full stop, file names
    "Ver el fin.documento y avi.avión, el archivo informe.doc, foto.jpg y nota.docx.",
    # digit phones, laws by number, makes of two words
    "Del teléfono 44445555 y el celular 1144445555, ley número 23737, "
    + " ".join(f"marca {m}," for m in vocab.CAR_MAKES_TWO_WORDS) + " fin.",
    "Cuentas en " + ", ".join(b for b in vocab.BANKS if "?" not in b) + ".",
    " ".join(f"{c} J-0{i}-00001234-1/2020-0," for i, c in enumerate(vocab.CUIJ_PREFIXES)) + " caso 12, causa nº 77.",
    "La víctima tenía 17 años. La propiedad de 30 años fue tasada. Edad 20 años",
    "ok",
]
K = len(BRANCHES)

# base entities per branch, token positions relative to the branch sentence
BASE_SPANS = [
    (2, 3, 4, "LOC"),
    (11, 3, 5, "PER"), (11, 8, 10, "PER"), (11, 13, 15, "PER"),
    (12, 2, 4, "PER"), (12, 7, 9, "PER"), (12, 13, 15, "PER"), (12, 18, 19, "LOC"),
]

#: doc_id, branch and text of a ruling from its order
RULING_COLUMNS = [
    "o_orderkey AS doc_id",
    f"CAST(o_orderkey % {K} AS INT) AS branch",
    f"""concat('Buenos Aires, ', CAST(day(o_orderdate) AS VARCHAR(20)), ' de ', {MONTH_CASE}, ' de ',
              CAST(year(o_orderdate) AS VARCHAR(20)), '. CUIJ: IAP J-01-',
              lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0'), '-1/2020-0 actuación nro: ',
              CAST(o_orderkey AS VARCHAR(20)), '/2020. ',
              CASE CAST(o_orderkey % {K} AS INT) {' '.join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BRANCHES))} END
       ) AS text""",
]

RULINGS_SQL = """
SELECT """ + """,
       """.join(RULING_COLUMNS) + """
FROM orders
"""

_BASE_VALUES = ", ".join(f"({b}, {s}, {e}, '{lab}')" for b, s, e, lab in BASE_SPANS)
BASE_SPANS_SQL = f"""
SELECT doc_id, 0 AS tok_start, 2 AS tok_end, 'LOC' AS label FROM rulings
UNION ALL
SELECT r.doc_id, b.ts + {PREFIX_TOKENS} AS tok_start, b.te + {PREFIX_TOKENS} AS tok_end, b.label
FROM rulings r JOIN (VALUES {_BASE_VALUES}) AS b(branch, ts, te, label) ON r.branch = b.branch
"""

LABEL_CASE = "CASE l_returnflag WHEN 'A' THEN 'PER' WHEN 'N' THEN 'LOC' ELSE 'DIRECCIÓN' END"

GOLD_SQL = f"""
SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 10 AS tok_start,
       l_linenumber * 10 + 1 + CAST(l_quantity AS INT) % 5 AS tok_end, {LABEL_CASE} AS label
FROM lineitem
"""

PRED_SQL = """
SELECT DISTINCT doc_id,
       CASE WHEN (doc_id * 7 + tok_start) % 7 = 0 THEN tok_start + 1 ELSE tok_start END AS tok_start,
       tok_end,
       CASE WHEN (doc_id * 7 + tok_start) % 13 = 0 THEN (CASE WHEN label = 'PER' THEN 'LOC' ELSE 'PER' END)
            ELSE label END AS label
FROM gold
WHERE (doc_id * 7 + tok_start) % 11 <> 0
"""

RAW_ANN_SQL = f"""
SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 3 AS ann_start,
       l_linenumber * 3 + CAST(l_quantity AS INT) % 9 AS ann_end, {LABEL_CASE} AS label
FROM lineitem
"""

# char spans over rulings: the date, the CUIJ number and the actuación number;
# documents with doc_id % 5 = 0 get the date start shifted by one char.
ANN_LENGTHS = """length(concat(CAST(day(o_orderdate) AS VARCHAR(20)), ' de ', MONTHNAME_, ' de ',
                       CAST(year(o_orderdate) AS VARCHAR(20)))) AS date_len,
         length(concat('J-01-', lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0'), '-1/2020-0')) AS cuij_len,
         length(concat(CAST(o_orderkey AS VARCHAR(20)), '/2020')) AS act_len""".replace("MONTHNAME_", MONTH_CASE)
ANN_SPANS = [
    ("CASE WHEN doc_id % 5 = 0 THEN 15 ELSE 14 END AS char_start", "14 + date_len AS char_end", "'FECHA' AS label"),
    ("14 + date_len + 12 AS char_start", "14 + date_len + 12 + cuij_len AS char_end", "'NUM_CUIJ' AS label"),
    ("14 + date_len + 12 + cuij_len + 16 AS char_start", "14 + date_len + 12 + cuij_len + 16 + act_len AS char_end",
     "'NUM_ACTUACIÓN' AS label"),
]
ANN_SQL = f"""
WITH p AS (
  SELECT doc_id, text,
         {ANN_LENGTHS}
  FROM rulings JOIN orders ON rulings.doc_id = orders.o_orderkey
)
SELECT doc_id, {ANN_SPANS[0][0]}, {ANN_SPANS[0][1]},
       {ANN_SPANS[0][2]} FROM p
UNION ALL
SELECT doc_id, {", ".join(ANN_SPANS[1])} FROM p
UNION ALL
SELECT doc_id, {ANN_SPANS[2][0]}, {ANN_SPANS[2][1]},
       {ANN_SPANS[2][2]} FROM p
"""

# The rows of ANN_SQL for Spark, which would join the orders with themselves once per span: a ruling meets every
# order of its key, so each order's spans come as often as its key does, and one deal of the orders by key makes them.
ANN_SPARK_SQL = f"""
WITH p AS (
  SELECT o_orderkey AS doc_id, n,
         {ANN_LENGTHS}
  FROM (SELECT o_orderkey, o_orderdate, count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders WHERE o_orderkey IS NOT NULL)
)
SELECT doc_id, inline(flatten(array_repeat(array({", ".join(f"struct({', '.join(x)})" for x in ANN_SPANS)}), CAST(n AS INT)))) FROM p
"""

HISTORY_SQL = """
WITH d AS (
  SELECT CAST(user_id % 20 AS INT) AS session, CAST(ts AS DATE) AS day,
         count(*) AS n, avg(value) AS mean_v, min(value) AS min_v, max(value) AS max_v
  FROM events GROUP BY CAST(user_id % 20 AS INT), CAST(ts AS DATE)
)
SELECT session,
       CAST(row_number() OVER (PARTITION BY session ORDER BY day) AS INT) AS epoch,
       CAST(n AS INT) AS batches,
       floor(CAST(1000 AS DOUBLE) / n * 1000000) / 1000000 AS ner,
       floor(mean_v * 1000000) / 1000000 AS val_f_score,
       floor(mean_v * 0.9 * 1000000) / 1000000 AS val_precision,
       floor((mean_v + max_v) / 2 * 1000000) / 1000000 AS val_recall,
       floor((mean_v + min_v) / 2 * 1000000) / 1000000 AS f_score,
       floor(min_v * 1000000) / 1000000 AS precision,
       floor(max_v * 1000000) / 1000000 AS recall
FROM d
"""

DERIVED = {
    "rulings": (RULINGS_SQL, ["orders"]),
    "base_spans": (BASE_SPANS_SQL, ["rulings"]),
    "gold": (GOLD_SQL, ["lineitem"]),
    "pred": (PRED_SQL, ["gold"]),
    "raw_ann": (RAW_ANN_SQL, ["lineitem"]),
    "ann": (ANN_SQL, ["rulings", "orders"]),
    "history": (HISTORY_SQL, ["events"]),
}


#: tables that Spark makes by another SQL of the same rows
SPARK_SQL = {"ann": (ANN_SPARK_SQL, ["orders"])}


def _deps(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in DERIVED and n not in order:
            for d in DERIVED[n][1]:
                visit(d)
            order.append(n)

    for n in names:
        visit(n)
    return order


def derived_ctes(names: list[str]) -> list[str]:
    """``name AS (sql)`` for the derived tables ``names`` and their dependencies."""
    return [f"{n} AS ({DERIVED[n][0].strip()})" for n in _deps(names)]


def with_derived(body: str, names: list[str]) -> str:
    """``WITH`` clause defining the derived tables ``names`` (and what they
    need) in front of ``body`` -- the oracle form of a query."""
    ctes = [f"{n} AS ({DERIVED[n][0].strip()})" for n in _deps(names)]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a derived table (registers the driver tables and
    any derived tables it depends on as temp views)."""
    needed = [name] if name in SPARK_SQL else _deps([name])
    made = DERIVED | SPARK_SQL
    base = sorted({d for n in needed for d in made[n][1] if d not in DERIVED})
    register_tables(spark, sf_dir, base)
    for n in needed:
        spark.sql(made[n][0]).createOrReplaceTempView(n)
    return spark.table(name)

"""Chat formatting (operator 5): schema fingerprints choose the mapping to canonical turns.

A record is JSON of any layout.  Which of the registry's nested field paths it holds is
hashed to a fingerprint; a registry of declarative mappings, keyed by
fingerprint, says where the turns are.  Fields that no mapping names (ids, names, scores)
don't count.  Canonical turns are (role, text) pairs.
The template writes a turn as ``### role: text</turn>`` and a line end; inside
roles and texts the characters of the marks are escaped, so the output can be
read back without doubt.  The loss mask is a list of run lengths over the
output, true for exactly the assistant texts.

Only DataFrame functions: rows are converted where they are.

Defined results: null text is empty text, null role the empty role; records
whose fingerprint is not registered (no paths, a mix of layouts, an object where a text
belongs) and broken JSON of any length give no turns and are reported as layout ``unknown``; JSON null is
empty text; turns keep their order, ties by role and text;
repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
TURNS = "array<struct<role: string, text: string>>"
#: Fixed escapes: no character of a mark is left in escaped text, and each backslash starts an escape.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
JSON = {"maxStringLen": str((1 << 31) - 1)}
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``schema``: of the record.  ``turns``: (role, field) for flat layouts; or
    ``each``: (list field, role field, text field)."""

    name: str
    schema: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(",".join(sorted(self.paths)).encode()).hexdigest()


def _flat(name: str, *turns: tuple[str, str]) -> Layout:
    fields = sorted(f for _, f in turns)
    return Layout(name, ", ".join(f"{f} string" for f in fields), tuple(fields), turns)


def _listed(name: str, field: str, role: str, text: str) -> Layout:
    return Layout(name, f"{field} array<struct<{role}: string, {text}: string>>", (f"{field}[].{role}", f"{field}[].{text}"), (), (field, role, text))


LAYOUTS = (
    _flat("prompt", ("user", "prompt"), ("assistant", "response")),
    _flat("completion", ("user", "prompt"), ("assistant", "completion")),
    _flat("instruction", ("user", "instruction"), ("assistant", "output")),
    _flat("instruction-input", ("system", "instruction"), ("user", "input"), ("assistant", "output")),
    _flat("question", ("user", "question"), ("assistant", "answer")),
    _listed("messages", "messages", "role", "content"),
    _listed("conversations", "conversations", "from", "value"),
    _listed("turns", "turns", "speaker", "text"),
)


def outline(record: Column) -> Column:
    """A JSON record with its strings and nulls emptied (keys stay, escapes in them become ``~``):
    its structure, however long its texts."""
    plain = F.regexp_replace(record, r"(?s)\\.", "~")  # no quote inside a string is left
    empty = F.regexp_replace(plain, r'("[^"]*"\s*:)|(")[^"]*(")', "$1$2$3")  # keys whole, values as ""
    return F.regexp_replace(empty, r"(?<=[:,\[\s])null(?=[\s,\]}])", '""')


def known_paths(record: Column) -> Column:
    """The registry's field paths that a record holds, sorted; null for what isn't JSON.  A list's path counts
    if any element has it; a text's place that holds an object or a list is marked."""
    text = outline(record)
    flat = sorted({f for lay in LAYOUTS for _, f in lay.turns})
    lists = sorted(lay.each for lay in LAYOUTS if lay.each)
    schema = ", ".join([f"{f} string" for f in flat] + [f"{f} array<struct<{r}: string, {t}: string>>" for f, r, t in lists])
    value = F.from_json(text, schema, JSON)

    def there(name: str) -> Column:
        return F.when(value[name].rlike(r"^\s*[{\[]"), name + "{}").when(value[name].isNotNull(), name)

    def listed(field: str, part: str) -> Column:
        return F.when(F.exists(value[field], lambda e: e[part].isNotNull()), f"{field}[].{part}")

    paths = F.array(*[there(f) for f in flat], *[listed(f, part) for f, r, t in lists for part in (r, t)])
    return F.when(F.try_parse_json(text).isNotNull(), F.array_join(F.array_sort(F.array_compact(paths)), ","))


def with_layout(records: DataFrame, record: str) -> DataFrame:
    """``records`` plus ``layout`` (a registered name or ``unknown``)."""
    named = F.create_map(*[F.lit(x) for lay in LAYOUTS for x in (lay.fingerprint, lay.name)])
    fingerprint = F.sha2(known_paths(F.col(record)).cast("binary"), 256)
    return records.withColumn("layout", F.coalesce(named[F.coalesce(fingerprint, F.lit(""))], F.lit("unknown")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _one(names: Column, role: str, text: str) -> Callable[[Column], Column]:
    """Mapping of one list element; ``from`` fields use other names for the roles."""
    def turn(m: Column) -> Column:
        own = m[role]
        return _turn(F.coalesce(names[F.coalesce(own, F.lit(""))], own) if role == "from" else own, m[text])

    return turn


def canonical(record: Column, layout: Column) -> Column:
    """Canonical turns of a record, by the mapping of its layout."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    out = F.array().cast(TURNS)
    for lay in LAYOUTS:
        parsed = F.from_json(record, lay.schema, JSON)
        if lay.each:
            turns = F.transform(parsed[lay.each[0]], _one(names, *lay.each[1:]))
        else:
            turns = F.array(*[_turn(F.lit(role), parsed[f]) for role, f in lay.turns])
        out = F.when(layout == lay.name, turns.cast(TURNS)).otherwise(out)
    return F.coalesce(out, F.array().cast(TURNS))


def escape(text: Column, rules: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, mark in rules:  # the backslash first
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column, rules: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, mark in reversed(rules):  # the backslash last
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def opening(role: Column) -> Column:
    return F.concat(F.lit("### "), escape(role, ROLE_ESCAPES), F.lit(": "))


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(opening(t["role"]), escape(t["text"]), F.lit(END))), "")


def loss_runs(turns: Column) -> Column:
    """(length, loss) runs that cover the formatted text."""
    def runs(t: Column) -> Column:
        return F.array(F.struct(F.length(opening(t["role"])).alias("length"), F.lit(False).alias("loss")),
                       F.struct(F.length(escape(t["text"])).alias("length"), (t["role"] == "assistant").alias("loss")),
                       F.struct(F.lit(len(END)).alias("length"), F.lit(False).alias("loss")))

    return F.flatten(F.transform(turns, runs))


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, END)  # holds no character that is special in a pattern
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing follows the last mark
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^### ([^:]*): ", 1), ROLE_ESCAPES).alias("role"),
        unescape(F.regexp_replace(p, r"(?s)^### [^:]*: ", "")).alias("text")))


def read_loss(text: Column, runs: Column) -> Column:
    """The unescaped text under the loss mask.  Every third run is a turn's text; its place
    in the output is that of its turn, so no offsets are summed.  Pieces and runs are paired
    element by element: linear in the turns."""
    pieces = F.split(text, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    places = F.arrays_zip(F.filter(runs, lambda r, i: i % 3 == 0).alias("o"), F.filter(runs, lambda r, i: i % 3 == 1).alias("t"))
    said = F.zip_with(pieces, places, lambda p, z: F.when(
        z["t"]["loss"], unescape(F.substr(p, z["o"]["length"] + F.lit(1), z["t"]["length"]))).otherwise(""))
    return F.array_join(said, "")


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` plus ``layout``, ``turns``, ``formatted`` and ``loss_runs``."""
    out = with_layout(records, record)
    out = out.withColumn("turns", canonical(F.col(record), F.col("layout")))
    return out.withColumns({"formatted": formatted(F.col("turns")), "loss_runs": loss_runs(F.col("turns"))})


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): turn rows (conv_id, turn, role, text) as JSON records in the layout
    that their roles allow, as collections of different origin would hold them.  A
    conversation is one record, so its rows meet in one group."""
    text = F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    roles = F.transform("m", lambda t: t["role"])

    def are(*names: str) -> Column:
        return roles == F.array(*map(F.lit, names))

    def at(i: int) -> Column:
        return F.col("m")[i]["text"]

    known = F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    plain = F.forall(roles, lambda r: F.array_contains(known, r))
    other = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    record = (
        F.when(are("user", "assistant"), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(are("system", "user", "assistant"), F.to_json(F.struct(at(0).alias("instruction"), at(1).alias("input"), at(2).alias("output"))))
        .when(plain & (F.col("m")[0]["role"] == "user"), F.to_json(F.struct(F.transform(
            "m", lambda t: F.struct(other[t["role"]].alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform(
            "m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))))
    return convs.select("conv_id", record.alias("record"))


def chat_report(rows: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted output of all conversations."""
    out = format_records(as_records(rows)).select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("back"),
        read_loss(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")

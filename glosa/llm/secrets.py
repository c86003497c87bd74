"""Secret scans (operator 2): an incremental ledger of content-addressed blobs.

Every historical version of every path is addressed by the SHA-256 of its
content.  A ledger holds, per blob, the (rule, version) pairs already scanned
and their findings; only unseen pairs are scanned, each distinct blob once
however many paths hold it, and the findings are joined back to all paths.

A rule is a name, a pattern, the group whose length counts and its least
length; its version is a digest of these, so a changed rule is scanned anew and
the others are not.  Matches are leftmost and non-overlapping per rule; those
that are too short are dropped.  A private key is one match with its body.

Defined results: null content is the empty blob (no findings); repeated rows
and exact copies share a blob and each get its findings; an empty table gives
an empty result; any other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosa.llm.common import blank, scratch_path


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int
    least: int
    hints: tuple[bytes, ...]  # one of them, in lower case, is in every match

    @property
    def key(self) -> str:
        spec = f"{self.pattern}\n{self.group}\n{self.least}"
        return f"{self.name}@{hashlib.sha256(spec.encode()).hexdigest()[:12]}"


def either_case(word: str) -> str:
    """ASCII letters in either case, spelled out (engines differ in case folding)."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = ("(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 8, (b"password", b"passwd", b"secret", b"token", b"key")),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, (b"akia",)),
    Rule("hex", "[0-9a-f]+", 0, 32, ()),
)
#: A private key from its BEGIN line to its END line, whatever stands between (headers, quotes, escaped line
#: ends) but other such lines; without an END line, to the end of the base64 body: runs of 16 characters and
#: more, and shorter ones that fill the next line.  Possessive, so linear.
LINE_END = r"(?:\r?\n|(?:\\r)?\\n)"
KEY_HEADERS = rf"(?:{LINE_END}[\x20\t]*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
KEY_BODY = rf"""(?:(?:[\s"',>#*]|\\[rn])++[A-Za-z0-9+/]{{16,}}+={{0,2}}+|{LINE_END}[\x20\t]*+[A-Za-z0-9+/]++={{0,2}}+(?=[\x20\t]*+(?:{LINE_END}|["']|\Z)))*+"""
PEM = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-{{5,}}END [A-Z ]*PRIVATE KEY-----|{KEY_HEADERS}{KEY_BODY})"
JWT = Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, (b"eyj",))
ADDED_RULES = (
    Rule("pem", PEM, 0, 1, (b"-----begin ",)),
    JWT,
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 4, (b"://",)),
)
RULES = BASE_RULES + ADDED_RULES
FINDINGS = "array<struct<kind: string, start: int, end: int>>"


_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")


def jwt_places(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the jwt rule, linear: the pattern itself reads on to a run's end from each ``eyJ`` in it.  Here each run of
    its characters is read once and cut at its dots; a match goes from the first ``eyJ`` of a part to the end of the second part after it."""
    for run in _DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, i = run[0].split("."), run.start(), 0
        while i + 2 < len(parts):
            first = parts[i].find("eyJ")
            if 0 <= first < len(parts[i]) - 3 and parts[i + 1].startswith("eyJ") and len(parts[i + 1]) > 3 and parts[i + 2]:
                end = at + sum(map(len, parts[i: i + 3])) + 2
                yield at + first, end
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1


def scan(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    low = text.encode().lower()
    out = []
    for rule, pattern in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        if rule.pattern == JWT.pattern:
            out += [(rule.name, s, e) for s, e in jwt_places(text) if e - s >= rule.least]
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((rule.name, m.start(), m.end()))
    return out


def scan_column(text: Column, pending: Column, rules: tuple[Rule, ...]) -> Column:
    """Findings of the pending rules (array of rule keys) of each text."""
    # runs of at least 32 hexadecimal digits are the maximal runs that pass: the same matches, found faster
    fast = {r: re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if r.name == "hex" else r.pattern) for r in rules}
    by_key = {r.key: (r, fast[r]) for r in rules}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(FINDINGS)
    def _scan(texts: pa.Array, todo: pa.Array) -> pa.Array:
        return pa.array(
            [[dict(zip(("kind", "start", "end"), f)) for f in scan(t, [by_key[k] for k in keys])]
             for t, keys in zip(texts.to_pylist(), todo.to_pylist())], kind)

    return _scan.asNondeterministic()(text, pending)


def blob_id(content: str) -> Column:
    return F.sha2(blank(content).cast("binary"), 256)


def blob_findings(docs: DataFrame, content: str = "text", rules: tuple[Rule, ...] = RULES,
                  ledger_path: str | None = None) -> DataFrame:
    """Bring the ledger up to date with the contents in ``docs`` and return its findings
    under the current rules: (blob, findings), blobs without findings left out.

    ``ledger_path``: folder of the ledger, appended to; a new one in the shared
    folder when not given.  Ledger rows: (blob, rules scanned, findings)."""
    spark = docs.sparkSession
    place = ledger_path or scratch_path(spark, "blob-ledger")
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = docs.select(blob_id(content).alias("blob"), blank(content).alias("content")).groupBy("blob").agg(
        F.first("content").alias("content"))
    seen = read_ledger(spark, place)
    if seen is None:
        blobs = blobs.withColumn("pending", wanted)
    else:
        done = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        none = F.array().cast("array<string>")
        blobs = blobs.join(done, "blob", "left").withColumn(
            "pending", F.array_except(wanted, F.coalesce("done", none))).where(F.size("pending") > 0)
    blobs.select("blob", F.col("pending").alias("rules"),
                 scan_column(F.col("content"), F.col("pending"), rules).alias("findings")
                 ).write.mode("append").parquet(place)
    # a ledger row counts for the rules it was scanned with that are still current
    kinds = F.transform(F.array_intersect("rules", wanted), lambda k: F.split_part(k, F.lit("@"), F.lit(1)))
    current = F.filter("findings", lambda f: F.array_contains(F.col("kinds"), f["kind"]))
    # a pair may be in the ledger twice (two runs at once, an append repeated): each place counts once
    return (read_ledger(spark, place).where(F.size("findings") > 0).withColumn("kinds", kinds)
            .select("blob", F.explode(current).alias("finding")).groupBy("blob").agg(F.collect_set("finding").alias("findings")))


def scan_paths(docs: DataFrame, path: str = "doc_id", content: str = "text", rules: tuple[Rule, ...] = RULES,
               ledger_path: str | None = None) -> DataFrame:
    """(path, blob, findings): one row per row of ``docs`` (a row per path and version)."""
    known = blob_findings(docs, content, rules, ledger_path)
    none = F.array().cast(FINDINGS)
    return docs.select(F.col(path).alias("path"), blob_id(content).alias("blob")).join(known, "blob", "left").select(
        "path", "blob", F.coalesce("findings", none).alias("findings"))


def read_ledger(spark: SparkSession, place: str) -> DataFrame | None:
    """The ledger table, or None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"blob string, rules array<string>, findings {FINDINGS}").parquet(place)


def in_order(findings: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    own = F.filter(findings, lambda f: F.array_contains(F.array(*map(F.lit, kinds)), f["kind"]))
    rows = F.array_sort(F.transform(own, lambda f: F.struct(f["start"].alias("s"), place[f["kind"]].alias("k"), f["end"].alias("e"), f["kind"].alias("n"))))
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["n"], r["s"], r["e"])), ",")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger_path: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per input row."""
    base = [r.name for r in BASE_RULES]
    f = F.col("findings")

    def found(kind: str) -> Column:
        return F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan_paths(docs, doc_id, text, ledger_path=ledger_path).select(
        F.col("path").alias("doc_id"), *map(found, base), F.sha2(in_order(f, base).cast("binary"), 256).alias("base_sha256"),
        in_order(f, [r.name for r in RULES]).alias("spans"))


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array, findings: pa.Array, masks: pa.Array) -> pa.Array:
    out = []
    for text, found, mask in zip(texts.to_pylist(), findings.to_pylist(), masks.to_pylist()):
        parts, at = [], 0
        for s, e in sorted((f["start"], f["end"]) for f in found or ()):
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        out.append("".join([*parts, text[at:]]) if found else text)
    return pa.array(out, pa.string())


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mask: str = "[secret]",
                   ledger_path: str | None = None) -> DataFrame:
    """``docs`` with each found span (overlapping ones as one) replaced by ``mask``; texts
    without findings stay as they are, and the length column, if any, follows."""
    found = blob_findings(docs, text, RULES, ledger_path).select(
        F.col("blob").alias("__blob"), F.col("findings").alias("__findings"))
    out = docs.withColumn("__blob", blob_id(text)).join(found, "__blob", "left")
    out = out.withColumn("__masked", F.when(F.col("__findings").isNull(), F.col(text)).otherwise(
        _masked(F.when(F.col("__findings").isNotNull(), F.col(text)), F.col("__findings"), F.lit(mask))))
    changed = {text: F.col("__masked")}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("__findings").isNull(), F.col(n_chars)).otherwise(F.length("__masked").cast("long"))
    return out.select([changed.get(c, F.col(c)).alias(c) for c in docs.columns])

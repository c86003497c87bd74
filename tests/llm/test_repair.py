"""Operator 13 against all edit sequences, and against a plain search over output strings."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from glosa.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, first string, audit string"
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def moves(role, text, fault):
    """(cost, letter, what is written) of one row."""
    yield 2, "D", None
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        yield more, "K", (role, text)
        yield 1 + more, "R", ("user", text)
        yield 1 + more, "R", ("assistant", text)


def every_edit(rows):
    """Least (cost, audit) and its rows, over all edit sequences with up to two insertions in each gap."""
    fill = [[(5 * n, "I" * n, [(NAMES[r], "") for r in rs]) for rs in itertools.product("ua", repeat=n)] for n in range(3)]
    fill = [x for f in fill for x in f]
    best = None
    own = [list(moves(r, t, f)) for (_, r, t), f in zip(rows, faults(rows))]
    for gaps in itertools.product(fill, repeat=len(rows) + 1):
        for edits in itertools.product(*own):
            cost = sum(g[0] for g in gaps) + sum(e[0] for e in edits)
            if best is not None and cost > best[0]:
                continue
            told, audit = list(gaps[0][2]), gaps[0][1]
            for e, g in zip(edits, gaps[1:]):
                told += ([e[2]] if e[2] else []) + g[2]
                audit += e[1] + g[1]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in told)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, told
    return best


def search(rows):
    """The same by the least (cost, audit) of each kind of output so far."""
    def close(now):
        for _ in range(3):
            for (last, s), (cost, audit, told) in list(now.items()):
                r = "a" if last == "u" else "u"
                new = cost + 5, audit + "I", told + [(NAMES[r], "")]
                if (r, s or last == "s") not in now or new[:2] < now[r, s or last == "s"][:2]:
                    now[r, s or last == "s"] = new
        return now

    now = close({("", False): (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for (last, s), (cost, audit, told) in now.items():
            for c, letter, row in moves(role, text, fault):
                to = (last, s)
                if row:
                    r = row[0][:1]
                    if r == "u" and last in ("", "s", "a") or r == "a" and last == "u":
                        to = r, s
                    elif r == "s" and last == "" and letter == "K":
                        to = "s", True
                    else:
                        continue
                one = cost + c, audit + letter, told + ([row] if row else [])
                if to not in new or one[:2] < new[to][:2]:
                    new[to] = one
        now = close(new)
    return min((v for (last, _), v in now.items() if last in ("", "a")), key=lambda v: v[:2])


def expected(rows, find):
    turns = [t for t, _, _ in rows if t is not None]
    f = faults(rows)
    pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:])]
    cost, audit, told = find(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def conversations(n, most, seed):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        out[c] = ordered([(rng.choice([None, 0, 1, 2, 3, 3, 5, 9]), rng.choice(["user", "assistant", "assistant", "system", "user", "tool", " ", ""]),
                           rng.choice(["Yes.", "No!", "So", "why? \n", " ", "", "A.", "B", "C."])) for _ in range(rng.randint(1, most))])
    return out


def frame(spark, by_conv):
    rows = [(c, t, r, x, "f", "a") for c, rs in by_conv.items() for t, r, x in rs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_against_all_edits(spark):
    convs = conversations(60, 3, 3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(frame(spark, convs)).collect()}
    assert got == {c: expected(rows, every_edit) for c, rows in convs.items()}


def test_against_search(spark):
    convs = conversations(400, 14, 8)
    df = frame(spark, convs)
    report = repair.repair_report(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    assert got == {c: expected(rows, search) for c, rows in convs.items()}
    told = {}
    for r in repair.repaired_rows(df, report).orderBy("conv_id", "place").collect():
        assert len(told.setdefault(r["conv_id"], [])) == r["place"] and r["edit"] in "KRI"
        told[r["conv_id"]].append((r["role"], r["text"]))
    for c, rows in convs.items():
        assert told.get(c, []) == search(rows)[2]


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_damage_and_degenerate_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t}.") for c in range(120) for t in range(c % 7)]
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (500, None, "user", "Hi."), (501, 3, None, "Hi."), (501, 3, "user", None), (501, 3, "user", None)]
    rows += [(502, 0, "user", "x" * 2_000_000 + "."), (502, 1, "assistant", "y" * 2_000_000)]
    rows += [(600 + i, 0, "user", "One.") for i in range(60)]  # some lose their only row
    df = spark.createDataFrame([(*r, "f", "a") for r in rows], SCHEMA).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.damaged_report(df).collect()}
    after = {c: [] for c, *_ in rows}
    for c, *rest in damage(rows):
        after[c].append(tuple(rest))
    assert sum(not v for v in after.values()) > 1
    assert got == {c: expected(ordered(v), search) for c, v in after.items()}


def test_long_conversation(spark):
    """One conversation with most rows, whose readings stay apart over long blank stretches."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                               F.when((F.col("id") > 100) & (F.col("id") < 40_000), "").otherwise(F.concat(F.lit("t"), "id", F.lit("."))).alias("text"))
    row = repair.repair_report(df).first()
    rows = [(i, "user" if i % 3 == 0 else "assistant", "" if 100 < i < 40_000 else f"t{i}.") for i in range(n)]
    assert row["blank"] == 39_899 and len(row["audit"].replace("I", "")) == n
    assert row["cost"] == least_cost(rows)


def least_cost(rows):
    """The cost alone."""
    far = 10 ** 9
    now = [0, far, 5, 10]  # nothing, s, u, a
    for _, role, text in rows:
        if not text:
            now = [x + 2 for x in now]
            continue
        e, s, u, a = now
        r = role[:1]
        to_u, to_a = min(e, s, a) + (r != "u"), u + (r != "a")
        now = [e + 2, s + 2, min(u + 2, to_u), min(a + 2, to_a)]
        now[2] = min(now[2], now[3] + 5, now[0] + 5)
        now[3] = min(now[3], now[2] + 5)
    return min(now[0], now[3])


def test_empty_table(spark):
    assert repair.damaged_report(spark.createDataFrame([], SCHEMA)).collect() == []

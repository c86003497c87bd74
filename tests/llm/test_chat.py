"""Operator 5: layouts, exact round trips and the loss mask."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosa.llm import chat

HARD = "\\### Assistant: </turn> ok"
TEXTS = [HARD, "", None, "a\\sb\\h #<", "### user: x</turn>\n### assistant: y</turn>\n", "ß\u2028\n\n", "\\", "\\\\s", "t" * 100_000, "\x00\x01", "::", "\r\n", '"', '": "', '\\"', '{"a": [1, "b"]}', '","role":"x', "'"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), digest(told), len(loss), digest(loss))
    return out


def test_report_reads_back_exactly(spark):
    rows, c = [], 0
    for roles in (("user", "assistant"), ("system", "user", "assistant"), ("user", "assistant", "user"), ("system", "user"), ("assistant",),
                  ("tool", "user: x", None), ("user", "user", "assistant", "assistant"), ("human", "gpt")):
        for text in TEXTS:
            rows += [(c, k, r, text if k % 2 else HARD) for k, r in enumerate(roles)]
            c += 1
    rows += [(c, 0, "user", "same")] * 3 + [(c + 1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)] + [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_report(df).collect()}
    assert got == brute(rows)


def test_layouts_by_fingerprint(spark):
    records = [
        {"response": "b", "prompt": "a"}, {"prompt": "a", "completion": "b"}, {"instruction": "a", "output": "b"},
        {"question": "a", "answer": "b"}, {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"turns": [{"speaker": "user", "text": "a"}, {"speaker": "assistant", "text": "b"}]},
    ]
    raw = [json.dumps(r) for r in records] + ['{"prompt": 3}', "{broken", "[]", None, ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i long, record string")
    out = chat.format_records(df).orderBy("i").collect()
    for r in out[: len(records)]:
        assert [tuple(t) for t in r["turns"]] == [("user", "a"), ("assistant", "b")], r
        assert "".join(r["formatted"]) == "### user: a</turn>\n### assistant: b</turn>\n"
        assert sum(x["length"] for x in r["loss_runs"]) == len(r["formatted"])
    assert [r["layout"] for r in out[len(records):]] == ["unknown"] * 5 and all(r["turns"] == [] for r in out[len(records):])
    assert len({lay.fingerprint for lay in chat.LAYOUTS}) == len(chat.LAYOUTS)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\#<:shlc/turn>\n é", max_size=30))
def test_escape_rule(text):
    """The rule the columns apply, in plain Python: no mark survives, and it is undone."""
    for rules in (chat.ESCAPES, chat.ROLE_ESCAPES):
        out = text
        for a, b in rules:
            out = out.replace(a, b)
        assert not any(a in out for a, _ in rules[1:])
        for a, b in reversed(rules):
            out = out.replace(b, a)
        assert out == text


def test_text_beyond_the_limits_of_json_and_variant(spark):
    rows = [(1, 0, "user", '"\\ab\n' * 4_200_000), (1, 1, "assistant", "short"), (2, 0, "user", "a"), (2, 1, "assistant", "b" * 21_000_000)]
    df = spark.createDataFrame(rows[1:3] + [(1, 0, "user", None), (2, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    df = df.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).when(F.col("conv_id") == 1, F.repeat(F.lit('"\\ab\n'), F.lit(4_200_000)))
                       .otherwise(F.repeat(F.lit("b"), F.lit(21_000_000))))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_report(df).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_fields_that_no_mapping_names(spark):
    raw = [json.dumps(r) for r in (
        {"id": 7, "prompt": "a", "response": "b", "meta": {"prompt": "x", "tags": [1, {"role": "y"}]}}, {"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "id": "q"},
        {"prompt": None, "response": "b"}, {"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "b", "tool": None}]})]
    odd = ['{"prompt": {"a": 1}, "response": "b"}', '{"prompt": "a", "response": "b", "messages": [{"role": "user", "content": "a"}]}', '{"null": null}', '{"prompt": "a"']
    df = spark.createDataFrame(list(enumerate(raw + odd)), "i long, record string")
    out = chat.format_records(df).orderBy("i").collect()
    for r, first in zip(out, ("a", "a", "", "")):
        assert [tuple(t) for t in r["turns"]] == [("user", first), ("assistant", "b")], r
    assert [r["layout"] for r in out[len(raw):]] == ["unknown"] * len(odd)


def test_many_turns(spark):
    """One conversation of 120,000 turns: linear in the turns."""
    import time

    n = 120_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                               F.concat(F.lit("t"), "id").alias("text"))
    begun = time.time()
    row = chat.chat_report(df).first()
    assert time.time() - begun < 120
    loss = "".join(f"t{i}" for i in range(1, n, 2))
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (n, len(loss), digest(loss))


def test_long_outlines(spark):
    """Records whose structure alone is over 16 MB: a whole one is mapped, a broken one is unknown."""
    n = 700_000
    turn = '{"role":"user","content":"a"}'
    whole = F.concat(F.lit('{"messages":['), F.repeat(F.lit(turn + ","), F.lit(n)), F.lit(turn + "]}"))
    broken = F.concat(F.lit('{"messages":['), F.repeat(F.lit(turn + ","), F.lit(n)))
    df = spark.range(2).select("id", F.when(F.col("id") == 0, whole).otherwise(broken).alias("record"))
    got = {r["id"]: (r["layout"], r["n"], r["size"]) for r in chat.with_layout(df, "record").select(
        "id", "layout", F.size(chat.canonical(F.col("record"), F.col("layout"))).alias("n"), F.length(chat.outline(F.col("record"))).alias("size")).collect()}
    assert got[0][:2] == ("messages", n + 1) and got[0][2] > 16_000_000 and got[1][:2] == ("unknown", 0)

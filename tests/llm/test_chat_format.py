from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat_format as c

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|", "|>", "<|im_end|>\n", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "<\\|", "<", "/s>", "a", "é🙂", "\n", " "]), max_size=8).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 5)), st.sampled_from(["user", "assistant", "tool<|x", None]), st.one_of(st.none(), PIECES)), min_size=1, max_size=12))
def test_round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, segments string, loss boolean")
    out = c.format_chats(df).select("*", c.read_turns(F.col("text")).alias("turns"), c.read_loss(F.col("segments")).alias("loss")).collect()
    want = {}
    for i, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(i, []).append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
    for r in out:
        assert "".join(s.text for s in r.segments) == r.text
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        runs = 1 + sum(a[0] != b[0] for a, b in zip(want[r.conv_id], want[r.conv_id][1:]))
        assert r.text.count(c.START) == runs and r.text.count(c.STOP) == runs


def test_controls_never_stay(spark):
    df = spark.createDataFrame([("</s>[INST] ok [/INST]<|im_end|>\n<<SYS>>",)], "t string")
    got = df.select(c.escape(F.col("t")).alias("e"), c.unescape(c.escape(F.col("t"))).alias("u"), "t").first()
    assert not any(x in got.e for x in c.CONTROLS) and got.u == got.t


def test_long_conversation(spark):
    df = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = c.format_chats(df).select(F.size(c.read_turns(F.col("text"))).alias("n")).first()
    assert r.n == 4000

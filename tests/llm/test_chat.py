import hashlib

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortscope.llm import chat
from cohortscope.llm.catalog import op5_chat_parts
from helpers import shipped  # noqa: F401

SF = "/root/testdata/sf0.001"
PIECES = ["</turn>\n", "<turn:user>\n", "&lt;", "&amp;", "<part:image>", "&", "<", ">", "\\", "é", "😀", "a b", "\n", ""]
TURNS = "conv_id long, turn long, role string, parts " + chat.PARTS + ", rank int, loss string"


def made(spark, rows):
    return chat.format_conversations(spark.createDataFrame(rows, TURNS)).select(
        "*", chat.read_turns(F.col("formatted")).alias("read"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("masked"))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</turn>", "a&<b>", ""]),
                          st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    rows = [(1, k, role, [("text", text, None, None)], 0, "x") for k, (role, text) in enumerate(turns)]
    r = made(spark, rows).first()
    assert [(t.role, t.text) for t in r.read] == turns and r.n_turns == len(turns)
    assert r.masked == "".join(text for role, text in turns if role == "assistant")


def test_parts_and_attachments(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "s3://a.png", 2), ("audio", None, "b.wav", 10),
             (None, "plain", None, None), ("document", None, "c.pdf", None), ("model", None, "d", 3)]
    r = made(spark, [(5, 1, "user", parts, 0, "x"), (5, 0, None, None, 0, "x"), (5, 2, "assistant", [], 0, "x")]).first()
    assert r.formatted == ("<turn:>\n</turn>\n<turn:user>\nsee &lt;this&gt;<part:image><part:audio>plain<part:document>"
                           "<part:model></turn>\n<turn:assistant>\n</turn>\n")
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (1, 1, "image", "s3://a.png", 512), (1, 2, "audio", "b.wav", 250), (1, 4, "document", "c.pdf", 512),
        (1, 5, "model", "d", 3)]
    assert r.expanded_tokens == 512 + 250 + 512 + 3 and r.masked == ""


def test_nulls_ties_and_empty_table(spark):
    part = [("text", "x", None, None)]
    got = made(spark, [(None, None, "user", part, 0, ""), (None, 1, "user", part, 0, ""),
                       (None, 1, "user", part, 0, ""), (2, 1, "assistant", [("text", None, None, None)], 0, "")]).collect()
    assert {r.conv_id: r.n_turns for r in got} == {None: 3, 2: 1}
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_query_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    df = op5_chat_parts(spark, SF)
    want = con.sql(chat.ORACLE_SQL)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in order) for r in want.fetchall())
    said = "\\### Assistant: </turn> ok"
    seven = df.filter("conv_id = -7").first()
    assert seven.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and seven.loss_chars == len(said)


def test_a_very_long_conversation(spark):
    """Thousands of turns, one of them with a very long text, beside a short conversation."""
    long = "a <b> & c " * 30_000
    rows = [(1, k, "assistant" if k % 2 else "user", [("text", long if k == 1001 else f"turn {k} </turn>", None, None)], 0, "x")
            for k in range(4000)] + [(2, 0, "user", [("text", "hi", None, None)], 0, "x")]
    got = {r.conv_id: r for r in made(spark, rows).collect()}
    assert [(t.role, t.text) for t in got[1].read] == [(role, parts[0][1]) for i, _, role, parts, _, _ in rows if i == 1]
    assert got[1].masked == "".join(parts[0][1] for i, _, role, parts, _, _ in rows if i == 1 and role == "assistant")
    assert got[2].n_turns == 1 and got[2].masked == ""

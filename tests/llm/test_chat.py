import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from visigraph.llm import chat

PIECES = st.lists(st.sampled_from([*chat.Template().control, "\\", "<", "[", "/", "s>", "INST]", "a", " ", "ß😀", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]), PIECES), max_size=6))
def test_round_trip(turns):
    form = chat.Template()
    text, segments = form.write(turns)
    assert form.read(text) == turns
    assert form.trained(text, segments) == [t for r, t in turns if r == "assistant"]
    assert [a for a, _, _ in segments[1:]] == [b for _, b, _ in segments[:-1]]
    for _, t in turns:
        assert not any(c in form.escape(t) for c in form.control)


def test_turn_order():
    form = chat.Template()
    assert form.error(["system", "user", "assistant"]) is None
    assert form.error(["user", "assistant", "user"]) is None
    assert form.error(["user", "user"]) == "turn 1: user after asked"
    assert form.error(["assistant"]).startswith("turn 0")
    assert form.error(["user", "tool"]).startswith("turn 1")
    assert form.error([]) == "ends after start"


def test_edge_rows_as_sql(spark, same_as_sql):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, None, None, "x\\y"), (2, 0, "tool", "[INST]</s>"), (3, 0, "user", "😀"), (3, 0, "user", "😀"), (3, 1, "assistant", ""), (4, 0, "system", "<<SYS>>"), (4, 1, "user", "q" * 200_000)]
    got = same_as_sql(chat.op2_chat, chat.SQL, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS error", "1 AS turns"))
    hostile = got.where("conv_id = -1").first()
    assert hostile.loss_sha256 == hashlib.sha256(chat.HOSTILE.encode()).hexdigest() and hostile.n_turns == 2


def test_empty_and_null_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], kind)).count() == 0
    row = chat.digest(chat.format_chats(spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b")], kind))).first()
    assert row.conv_id is None and row.n_turns == 2 and row.error is None

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from draftloom.llm import chat

PIECES = st.lists(st.sampled_from(["\\", "### ", "###", "</turn>", "\n", " ", "a", ":", "assistant:", "é", "### user:\n", "\n</turn>\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    made = [chat.render_turn(role, text) for role, text in turns]
    assert [t[:2] for t in chat.parse("".join(m[0] for m in made))] == turns
    for (_, text), (piece, start, end) in zip(turns, made):
        assert chat.unescape(piece[start:end]) == text


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", "C:\\temp # x")[0] == "### user:\nC:\\temp # x\n</turn>\n"


def test_broken_text_is_refused():
    for text in ("### user:\nabc", "abc", "### user:\na ### b\n</turn>\n", "### user:\na</turn>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(text)


def test_digests(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", hard), (1, 2, "assistant", hard), (2, 0, None, None), (2, 0, None, None), (3, None, "user", "x"), (3, 0, "a:\n\\", "### "), (None, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert got[1].turns_sha256 == sha(f"user\n{hard}\nassistant\nb\nassistant\n{hard}\n") and got[1].n_turns == 3
    assert got[1].loss_sha256 == sha("b" + hard) and got[1].loss_chars == 1 + len(hard)
    assert got[2].n_turns == 2 and got[2].turns_sha256 == sha("\n\n\n\n") and got[2].loss_chars == 0
    assert got[3].turns_sha256 == sha("user\nx\na:\n\\\n### \n") and got[None].loss_chars == 100_000
    pieces = chat.format_turns(df).where("conv_id = 1").collect()
    assert got[1].formatted_chars == sum(len(p.rendered) for p in pieces)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_large_ids_beside_a_null(spark):
    rows = [(i, t, "user", f"text {i}") for i in (None, 2**53, 2**53 + 1, 2**53 + 2, -(2**62) - 1) for t in (2**53 + 1, 2**53, None)]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((str(r.conv_id), str(r.turn)) for r in formatted.collect()) == sorted((str(i), str(t)) for i, t, *_ in rows)
    got = {r.conv_id: r.n_turns for r in chat.read_back(formatted).collect()}
    assert got == {None: 3, 2**53: 3, 2**53 + 1: 3, 2**53 + 2: 3, -(2**62) - 1: 3}
    named = spark.createDataFrame([("a", 1, "user", "x"), (None, 1, "user", "y")], "conv_id string, turn int, role string, text string")
    assert sorted(str(r.conv_id) for r in chat.read_back(chat.format_turns(named)).collect()) == ["None", "a"]

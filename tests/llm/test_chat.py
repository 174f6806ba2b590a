"""Exact round trip of chat formatting, against a plain Python model."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stipendlens.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string, p int"
pieces = st.lists(st.sampled_from(["<|", "<\\|", "\\", "<", "|", "<|im_end|>", "<|im_sep|>", "<|im_start|>", "\n", "a", "é", "n"]),
                  max_size=7).map("".join)


def expected(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(v), digest("".join(f"{r}\n{x}\n" for _, _, r, x in sorted(v))),
                sum(len(x) for _, _, r, x in v if r == "assistant"),
                digest("".join(x for _, _, r, x in sorted(v) if r == "assistant"))) for c, v in out.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digest(df).collect()}
    assert got == expected(rows)
    sizes = {r["conv_id"]: r["n"] for r in chat.format_chat(df).select("conv_id", F.length("formatted").alias("n")).collect()}
    assert sizes == {r["conv_id"]: r["formatted_chars"] for r in chat.chat_digest(df).collect()}


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4), st.sampled_from(["user", "assistant", "a<|\nb\\", ""]), pieces),
                     min_size=1, max_size=25))
def test_round_trip_of_control_strings(spark, rows):
    check(spark, rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    check(spark, [(None, 0, "user", "x"), (1, None, "user", "n"), (1, 1, None, None), (1, 1, "assistant", None), (1, 1, "assistant", None),
                  (2, 0, "assistant", "y" * 300_000), (2, 0, "assistant", ""), (3, 5, "assistant", "a"), (3, 5, "user", "a")])


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat.format_chat(df).first()
    assert row["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    (span,) = row["loss_spans"]
    assert row["formatted"][span["start"]:span["start"] + span["len"]] == "c"


def test_empty_table(spark):
    assert chat.chat_digest(spark.createDataFrame([], TURNS)).count() == 0

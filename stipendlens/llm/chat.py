"""Chat formatting in Spark expressions.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role share a block

    <|im_start|>role NEWLINE text <|im_sep|> text ... <|im_end|> NEWLINE

so the merge stays readable turn by turn. Inside roles and texts every
backslash is doubled and ``<|`` is written ``<\\|`` (a role's newline
``<\\n``), so ``<|`` occurs in the output only where the template put it,
and ``read_turns`` gives back exactly what was formatted. The loss mask is a
list of (start, length) code-point spans, one per assistant turn.

Defined results: turns sort by (turn, role, text), NULLs first, so ties and
repeated rows stay, in a fixed order; NULL text or role: empty; NULL
conv_id: a conversation of its own; no rows: no conversations. A
conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> conv_id, formatted,
    loss_spans array<struct<start long, len long>> (0-based code points)."""
    empty = F.lit("")
    row = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("t", i - 1)["role"] != t["role"])
        last = (i == F.size("t") - 1) | (F.get("t", i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"),
                        F.when(last, F.lit(END + "\n")).otherwise(empty).alias("tail"),
                        (t["role"] == loss_role).alias("loss"))

    convs = convs.withColumn("p", F.transform("t", piece))
    spans = F.aggregate(
        "p", F.struct(F.lit(0).cast("long").alias("pos"),
                      F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["pos"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).alias("pos"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(
                (a["pos"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("len")))))
            .otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    formatted = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return convs.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>")))

    def turns_of(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)
        body = F.substr(body, F.lit(1), F.length(body) - F.lit(len(END) + 1))
        return F.transform(F.split(body, r"<\|im_sep\|>"),
                           lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")


def chat_digest(turns: DataFrame) -> DataFrame:
    """Formats and reads back: one row of counts and digests per conversation."""
    out = format_chat(turns).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                                    read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))

r"""Chat formatting by relational expressions only.

A conversation's rows are ordered by turn (then role and text, so ties have one
order; nulls first), runs of one role are merged into a block, and the blocks are
joined:

    <|im_start|>ROLE<|im_nl|>TEXT<|im_sep|>TEXT<|im_end|>

`<|im_sep|>` parts the texts of merged turns. Inside roles and texts a backslash is
doubled and `<|` becomes `<\|`, so no control string can come from a text, and
unescape() gives back what was written. The loss mask is an array of [start, end)
code points of `formatted`, one for each assistant turn, without any markers.

Null roles and texts are empty ones. Repeated rows are turns of their own. A null
conv_id is a conversation. Extra columns are not read. Turns are collected per
conversation, since its formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, NL, SEP, END = "<|im_start|>", "<|im_nl|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_mask (array of start, end) of each conversation."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_before": F.lag("role").over(order), "_i": F.row_number().over(order)})
    opens = F.concat(F.when(F.col("_before").isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(START), escape(F.col("role")), F.lit(NL))
    rows = rows.withColumn("_head", F.when(F.col("_before") == F.col("role"), F.lit(SEP)).otherwise(opens)).withColumn("_body", escape(F.col("text")))
    size = F.char_length(F.concat("_head", "_body")).cast("long")
    rows = rows.withColumn("_end", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)))
    turn = F.struct(F.col("_i"), F.concat("_head", "_body").alias("piece"), (F.col("_end") - F.char_length("_body")).alias("start"), F.col("_end").alias("end"), (F.col("role") == loss_role).alias("loss"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    mask = F.transform(F.filter("_t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select("conv_id", F.concat(F.array_join(F.transform("_t", lambda t: t["piece"]), ""), F.lit(END)).alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, an array of (role, text)."""
    quoted = lambda x: "\\Q" + x + "\\E"
    blocks = F.filter(F.split(formatted, quoted(END)), lambda b: b != "")

    def of(block: Column) -> Column:
        role = F.substring_index(block, NL, 1)
        texts = F.split(F.substr(block, F.char_length(role) + 1 + len(NL)), quoted(SEP))
        return F.transform(texts, lambda t: F.struct(unescape(F.substr(role, F.lit(len(START) + 1))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts and their masks."""
    read = made.select("conv_id", parse(F.col("formatted")).alias("_turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("_loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")

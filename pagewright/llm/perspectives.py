"""Multi-party perspective rotation: every dialogue once for each participant, who then is the assistant.

The unit is the turn. A conversation of any length is therefore never held by one task: order and offsets come from one
range exchange and two levels of prefix sums, inside a partition and over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

#: The markup of a rendered turn: header, name, text, end.
OPEN, NAME, CLOSE, END = "<|im_start|>", " name=", "\n", "<|im_end|>\n"
UNKNOWN = "unknown"


def _escaped(text: Column) -> Column:
    """Markup inside a text must not read as markup of the dialogue."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<\\\\|$1|>")


def rotate_perspectives(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = ("system",), partitions: int | None = None
) -> DataFrame:
    """Rows (conv_id, perspective, seq, turn, role, name, rendered, char_start, char_end, mask_start, mask_end, masked).

    For every participant (a speaker of the conversation that is not context) and every turn one row. The participant's
    own turns have the role assistant, those of others the role user and the speaker's name, context turns keep their
    role. Joined in order of seq, the rendered texts of a perspective are its dialogue; char_start and char_end are the
    place there. A loss covers [mask_start, mask_end), the text and end mark of assistant turns; masked says that a row
    has no loss, and its range is empty. Turns go by number (null first), then speaker, then the MD5 of the text, whatever
    the partitions; repeated rows are repeated turns. A null or empty speaker is the participant "unknown", a null text
    is empty, and turns without conversation id form one conversation. A conversation of context turns alone has no
    perspective and gives no rows, as does an empty table.

    The text goes through two exchanges, by range and by row; order and places come from rows of lengths alone.
    """
    spark = turns.sparkSession
    ws = Workspace(spark, "perspectives")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    speaker = F.when(F.coalesce(F.trim(speaker_col), F.lit("")) == "", UNKNOWN).otherwise(F.col(speaker_col))
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), _escaped(F.col(text_col)).alias("text"))
    # rows that agree in all of these are the same; the last one only lets a frequent row spread over partitions
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv", "turn", "speaker", "digest", "tie"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = ws.table(rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).drop("tie", "digest"))

    is_context = F.col("speaker").isin(list(context))
    narrow = rows.select("conv", "speaker", "part", "row", F.length("text").alias("length"))
    people = ws.table(rows.where(~is_context).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct())
    seen = narrow.join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(is_context, F.col("speaker")).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = lambda role, name: F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(NAME), name)).otherwise(""), F.lit(CLOSE))
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    seen = seen.withColumn("head", F.length(head(F.col("role"), F.col("name")))).withColumn("n", (F.col("head") + F.col("length") + len(END)).cast("long")).drop("speaker", "length")

    # where a perspective of a conversation stands when a partition begins
    sums = seen.groupBy("conv", "perspective", "part").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv", "perspective", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0"))
    base = base.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("q"), "n0", "k0")
    inside = Window.partitionBy("part", "conv", "perspective").orderBy("row")
    local = seen.withColumn("end", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(inside))
    placed = local.join(base, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("q")))
    placed = placed.select("row", "perspective", "role", "name", "head", "n", "k", "end", "n0", "k0")
    out = placed.join(rows.select("row", "conv", "turn", "text"), "row")
    start, end = (F.col("n0") + F.col("end") - F.col("n")), (F.col("n0") + F.col("end"))
    own = F.col("role") == "assistant"
    return out.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        (F.col("k0") + F.col("k") - 1).cast("long").alias("seq"),
        "turn",
        "role",
        "name",
        F.concat(head(F.col("role"), F.col("name")), "text", F.lit(END)).alias("rendered"),
        start.alias("char_start"),
        end.alias("char_end"),
        F.when(own, start + F.col("head")).otherwise(end).alias("mask_start"),
        end.alias("mask_end"),
        (~own).alias("masked"),
    )


def dialogues(rotated: DataFrame, turns: int = 10_000) -> DataFrame:
    """Dialogues (conv_id, perspective, part, dialogue, loss_spans), cut into parts of at most `turns` turns each.

    The parts of a perspective, in order, are its whole dialogue; loss_spans are places in the part. A perspective of more
    turns has more parts, so no task holds an unbounded dialogue and no turn is left out.
    """
    cut = F.floor(F.col("seq") / turns).alias("part")
    parts = rotated.groupBy("conv_id", "perspective", cut).agg(F.array_sort(F.collect_list(F.struct("seq", "rendered", "mask_start", "mask_end", "char_start"))).alias("xs"))
    first = F.element_at("xs", 1)["char_start"]
    spans = F.transform("xs", lambda x: F.struct((x["mask_start"] - first).alias("start"), (x["mask_end"] - first).alias("end")))
    loss = F.filter(spans, lambda s: s["start"] < s["end"])
    return parts.select("conv_id", "perspective", "part", F.array_join(F.transform("xs", lambda x: x["rendered"]), "").alias("dialogue"), loss.alias("loss_spans"))

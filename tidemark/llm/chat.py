"""Chat formatting by perspective rotation, with DataFrame and SQL functions only.

For every participant of a conversation the dialogue is rendered once, with that speaker as the assistant and all other
speakers as named users; system turns stay system turns. A row of the result is one turn of one rendering: its text, its
place in the whole rendering (`start` to `end`, in characters) and the span that a loss may use (`mask_start` to
`mask_end`: what the assistant says, and its end mark), or nulls. The renderings are the rows in the order of
`position`; no conversation has to fit into one task: turns are dealt out in ranges of conversation, turn, speaker and
text, with a number of their own behind, so not even equal rows stay together; offsets are summed per range first.

Turns stand in order of turn (null first), then speaker and text; rows that are equal in all of these are the same
rendered. Speakers are roles; a null role is the speaker `unknown`, a null text is empty, a null conv_id is a
conversation of its own. Repeated rows are rendered repeatedly. Marks inside a text or a speaker's name are broken by a
space, and line breaks in a name become spaces, so neither can open a turn. A conversation of system turns only has no
participant and no rows. Empty table: empty result. Columns other than conv_id, turn, role and text are neither read nor
returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def broken(text: Column) -> Column:
    """Marks inside it are no marks any more."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", r"<|$1 |>")


def dealt(turns: DataFrame) -> DataFrame:
    """The rows in consecutive ranges of their order, as a table; `part` numbers the ranges."""
    order = ["conv_key", "turn", "speaker", "said", "own"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(n, *order)
    return written(ranged.withColumn("part", F.spark_partition_id()).drop("own"), "chat-turns")


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, rendered, start, end, mask_start and mask_end, of rows of conv_id, turn, role and text."""
    turns = dealt(
        turns.select(
            "conv_id",
            F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv_key"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("speaker"),
            broken(F.coalesce("text", F.lit(""))).alias("said"),
        )
    )
    parties = turns.where("speaker <> 'system'").select("conv_key", F.col("speaker").alias("perspective")).distinct()
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == "system"
    head = F.when(system, F.lit(f"{OPEN}system\n")).when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), broken(F.regexp_replace("speaker", r"[\r\n]+", " ")), F.lit("\n")))
    rows = turns.join(parties, "conv_key").withColumn("head", head).withColumn("rendered", F.concat("head", "said", F.lit(f"{CLOSE}\n"))).withColumn("size", F.char_length("rendered").cast("long"))
    keys = ["conv_key", "perspective", "part"]
    before = Window.partitionBy("conv_key", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum("size").alias("all_size"), F.count("*").alias("all_rows"))
    sums = sums.select(*keys, F.coalesce(F.sum("all_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("all_rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy(*keys).orderBy("turn", "speaker", "said")
    rows = rows.withColumn("own_size", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("own_row", F.row_number().over(inside))
    end = F.col("size_before") + F.col("own_size")
    start = end - F.col("size")
    return rows.join(sums, keys).select(
        "conv_id",
        "perspective",
        (F.col("rows_before") + F.col("own_row") - 1).alias("position"),
        "turn",
        "speaker",
        "rendered",
        start.alias("start"),
        end.alias("end"),
        F.when(own, start + F.char_length("head")).alias("mask_start"),
        F.when(own, end - 1).alias("mask_end"),
    )


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS said
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, speaker, said,
         CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || replace(replace(regexp_replace(speaker, '[\r\n]+', ' ', 'g'), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS rendered FROM r),
w AS (
  SELECT *, CAST(row_number() OVER o - 1 AS BIGINT) AS position,
         CAST(sum(length(rendered)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said))
SELECT conv_id, perspective, position, turn, speaker, rendered, "end" - length(rendered) AS start, "end",
       CASE WHEN speaker = perspective THEN "end" - length(rendered) + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN "end" - 1 END AS mask_end
FROM w
"""

"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's documents, in a pseudorandom order, form one stream of words that is packed into blocks of BLOCK words.
A source's target gives its number of slots. The mix has output shards of about SHARD_SLOTS slots, and the counts of
sources in a shard are multinomial: every slot of a source draws its shard where a uniform hash falls among the
cumulative thresholds of the shards, so shards differ in their counts but the sources keep their totals. The drawn counts
(a row for each source and shard) give each shard its range of a source's slots. A source's slots run through
permutations of its block indices: pass 0 takes every block once before pass 1 takes any again. Slots and blocks are
joined by index.

Prefix sums run in hash buckets of a source, whose sums are added up first, so no source meets in one task. A null text
and a text without words have size 0 and are never taken; a null source is a source of its own, after all others. Rows
of equal doc_id are all kept, each is placed on its own; rows that are equal in doc_id and size are told apart by
nothing, so which of them takes which place is open. Empty table: empty result. Further columns are left alone: the
operators keep their own columns apart from those of the table, whatever the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, written

BLOCK = 128
SHARE, MOST = 1.5, 2.0
WEIGHTS = (3, 1, 2)
#: Hash buckets of a source; slots that one row of the slot generator makes; slots of an output shard, on average.
BUCKETS, CHUNK, SHARD_SLOTS = 16_384, 4096, 16_384
SEED = 17
WORD = r"[^ \t\n\x0B\f\r]+"
#: Primes above 2^43, each a multiplier coprime to every smaller number of blocks.
PRIMES = (8796093022237, 8796093022247, 8796093022261, 8796093022313, 8796093022349, 8796093022391, 8796093022393, 8796093022427)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to source, source_size. By falling room for its weight, a source is full as long as the level of the
    others, if all before it are full, is above its own. The table has a row for each source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def permuted(index: Column, of: Column, key: list[Column]) -> Column:
    """A pseudorandom permutation of 0..of-1 for each key; the product is exact for any number of blocks."""
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(len(PRIMES))) + 1).cast("int"))
    wide = lambda c: c.cast("decimal(19,0)")
    return F.pmod(wide(prime) * wide(index) + wide(F.pmod(F.xxhash64(F.lit(SEED + 1), *key), of)), wide(of)).cast("long")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows over as many tasks as the session's shuffles have; a number of its own keeps them apart however few they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def drawn(plan: DataFrame, shards: int) -> DataFrame:
    """source_key, blocks, shard, n and first: how many slots of a source a shard has drawn, and the first of them."""
    chunks = spread(plan.where("n > 0").select("source_key", "blocks", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk")), "source_key", "chunk")
    each = chunks.select("source_key", "blocks", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("i"))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 3), "source_key", "i"), 11) / F.lit(float(1 << 53))
    counts = each.groupBy("source_key", "blocks", F.floor(uniform * shards).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-draws")


def mix(docs: DataFrame, block: int = BLOCK, share: float = SHARE, most: float = MOST, fixed: str | None = None, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows of doc_id, source and size: (placed, parts, slots). fixed: a column with places from an earlier call, to be kept.

    placed: the rows with source_size, target and `at`, where a document begins in its source's stream.
    parts: the words of each document in each block, `low` to `high` of the document, with source_key and block.
    slots: source_key, block, pass, shard; what the mix takes, one block each.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    docs = docs.withColumn("source_key", key).withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(BUCKETS)).cast("int"))
    sums = written(docs.groupBy("source", "source_key", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, most)
    plan = (
        goal.withColumn("source_key", key)
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.least("blocks", F.round((F.col("target") - F.col("whole") * F.col("source_size")) / block).cast("long")))
        .withColumn("n", F.col("whole") * F.col("blocks") + F.col("rest"))
    )
    plan = written(plan, "mix-plan")
    in_source = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(plan.select("source_key", "source_size", "target").hint("merge"), "source_key").select("source_key", "bucket", "source_size", "target", F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy(F.xxhash64(F.lit(SEED + 2), "doc_id"), "doc_id", "size")
    placed = docs.withColumn("at", F.col(fixed)) if fixed else docs.join(offsets.hint("merge"), ["source_key", "bucket"]).withColumn("at", F.col("before") + F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).drop("before", "bucket")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.withColumn("low", F.greatest(F.lit(0), F.col("block") * block - F.col("at"))).withColumn("high", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("at")))
    everything = plan.agg(F.sum("n")).first()[0] or 0
    draws = spread(drawn(plan, max(1, -(-everything // shard_slots))), "source_key", "shard")
    index = draws.select("source_key", "blocks", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i"))
    turn = F.floor(F.col("i") / F.col("blocks"))
    slots = index.select("source_key", turn.alias("pass"), permuted(F.pmod("i", "blocks"), F.col("blocks"), [F.col("source_key"), turn]).alias("block"), "shard")
    return placed, parts, slots


def taken(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the first and last output shard that takes words of it (null if none does), for every row of doc_id, source and size."""
    placed, parts, slots = mix(docs.select("doc_id", "source", "size"), block, shard_slots=shard_slots)
    times = slots.groupBy("source_key", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    joined = parts.join(times.hint("merge"), ["source_key", "block"], "left")
    shards = [F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard")]
    words = joined.groupBy("source_key", "at", "doc_id", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.coalesce(F.sum((F.col("high") - F.col("low")) * F.col("times")), F.lit(0)).alias("taken"), *shards)
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard"]
    nothing = {"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("int"), "last_shard": F.lit(None).cast("int")}
    return words.select(columns).unionByName(placed.where("size = 0").withColumns(nothing).select(columns))


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself, of rows of doc_id, source and text: a row for each document's part of a taken block, with its output
    shard, source_key, block, pass, doc_id, place in the block (`offset`, in words), and its words."""
    said = docs.select("doc_id", "source", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("said"))
    placed, parts, slots = mix(said.withColumn("size", F.greatest(F.coalesce(F.size("said"), F.lit(0)), F.lit(0)).cast("long")), block, shard_slots=shard_slots)
    pieces = parts.select("source_key", "block", "doc_id", (F.col("at") + F.col("low") - F.col("block") * block).alias("offset"), F.slice("said", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("words"))
    return slots.join(pieces.hint("merge"), ["source_key", "block"]).select("shard", "source_key", "block", "pass", "doc_id", "offset", "words")


def mixed_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of the mix: a row for each pass that takes words of a document, with its columns. The text is the
    document's own where the pass takes it whole, else its taken words, in their order, with single spaces. Which output
    shard a block goes to is in mixed_blocks; a row here has the blocks of all shards."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    placed, _, _ = mix(whole, block)
    placed = written(placed.where("size > 0"), "mix-placed")
    _, parts, slots = mix(placed.select("doc_id", "source", "size", F.col("at").alias("fixed_at")), block, fixed="fixed_at")
    own = ["source_key", "at"]
    spans = parts.select(*own, "block", "low", "high").join(slots.select("source_key", "block", "pass").hint("merge"), ["source_key", "block"])
    spans = spans.groupBy(*own, "pass").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"), F.sum(F.col("high") - F.col("low")).alias("words"))
    rows = placed.join(spans.hint("merge"), own)
    said = F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("spans", lambda x: F.slice(said, (x["low"] + 1).cast("int"), (x["high"] - x["low"]).cast("int")))), " ")
    rows = rows.select("doc", F.when(F.col("words") == F.col("size"), F.col("doc.text")).otherwise(part).alias("said"))
    new = {"text": F.col("said"), "n_chars": F.char_length("said")}
    return rows.select(*((new[f.name].cast(f.dataType) if f.name in new else F.col(f"doc.`{f.name}`")).alias(f.name) for f in docs.schema))


def sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-docs")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(sized(documents(spark, sf_dir, "doc_id", "source", "text")))

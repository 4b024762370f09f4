"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents, shuffled by a hash, form one line of words. The mix has 2**k slots. Slot i has the
van der Corput point of i (its bits mirrored), which falls into one source's interval of the cumulative
weights; slots are ranked within their source, and the slot of rank r carries the r-th block of the
source's line, lap after lap. A source gets its target to one word, however large the mix and however small the
source: slots give the order only. A source's words are cut into as many equal blocks (to one word) as it has slots,
so any run of slots is close to the target weights. The slots are as many as keep a slot to about ``SLOT_WORDS`` words
(2**18 at least, or one a word): they grow with the mix. A source whose interval holds no point goes, whole, with the
slot whose point is the last before it.

Running sums (places on the line, ranks of slots) are two-level: within buckets of about the square root of
a source's documents, and over the buckets. So neither a source with most of the rows nor one
with most of the slots gathers in one task. Points meet intervals by an equality join on cells of a grid.

Edge cases: null texts have size 0 and are not taken; a null source is the last one; repeated rows each have
their place on the line (equal rows may swap theirs); an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relquill.llm._shared import BROADCAST_IDS, WORD, read_table, stage

#: Slots are 2**SLOT_BITS at least (but one a word at most), and as many as keep a slot to SLOT_WORDS words.
SLOT_BITS, SLOT_WORDS = 18, 1024
MOST = 3  # times a source's own words that the mix may take


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one, by bucket, then ``order``."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__s"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__s").over(w), F.lit(0))).drop("__s")
    renamed = sums.select(*[F.col(c).alias(f"__{c}") for c in [*group, bucket]], "__base")
    same = [F.col(c) == F.col(f"__{c}") for c in [*group, bucket]]
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    got = got.join(renamed, same).withColumn(out, (F.col("__base") + F.col("__in")).cast("long"))
    return got.drop("__in", "__base", *[f"__{c}" for c in [*group, bucket]])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """From (key, docs, source_size), one row a source: adds the target, and its interval [lo, hi) of the unit line.

    Weights repeat over the sources in order. Where a target stops at ``most`` times the source, the rest is shared
    among the others by weight, again and again: the level at which this ends is the first, in
    order of limit / weight, at which the remaining sources' shares fit under their limits.
    """
    by_key = Window.orderBy("key")
    n = F.row_number().over(by_key) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(n, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * most)
    every = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("fits", F.col("cap") >= F.col("level") * F.col("w"))
    s = s.withColumn("free", F.max(F.when(F.col("fits"), F.col("level"))).over(every))
    s = s.withColumn("target", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("free") * F.col("w"))))
    s = s.withColumn("hi", F.sum("target").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.greatest(F.col("total"), F.lit(1)))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(by_key), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.desc("key")))
    s = s.withColumn("hi", F.when(last == 1, F.lit(1.0)).otherwise(F.col("hi")))  # the sum may end a rounding below 1
    return s.select("key", "docs", "source_size", "total", "target", "lo", "hi")


def slot_exponent(total: int, slot_bits: int | None = None) -> int:
    """k of the 2**k slots of a mix of ``total`` words; ``slot_bits`` sets it, but for mixes of fewer words."""
    if slot_bits is None:
        slot_bits = max(SLOT_BITS, (total // SLOT_WORDS).bit_length())
    return min(max(total, 1).bit_length() - 1, slot_bits)


def schedule(spark: SparkSession, targets: DataFrame, slot_bits: int | None = None) -> DataFrame:
    """(key, rank, slot): which block of which source each slot of the mix carries.

    A source between two points shares the slot of the one before it, so every source with a target has a slot.
    """
    total, sources = targets.agg(F.max("total"), F.count(F.lit(1))).first()
    k = slot_exponent(int(total or 0), slot_bits)
    # so many cells that one holds few sources and few points
    cells = 1 << max(10, k - 12, sources.bit_length())
    grid = targets.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    grid = grid.select("key", "lo", "hi", "cell")
    # slot i, its k bits mirrored
    points = spark.range(1 << k).select(
        F.col("id").alias("slot"),
        (F.conv(F.reverse(F.lpad(F.bin("id"), max(k, 1), "0")), 2, 10).cast("long") / F.lit(float(1 << k))).alias("u"),
    )
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    slots = points.join(grid, "cell").where("u >= lo AND u < hi").select("key", "slot")
    slots = slots.withColumn("bucket", F.col("slot").bitwiseAND(F.lit(511))).withColumn("one", F.lit(1))
    # a slot's bucket is its remainder, so ranks follow the buckets first; any fixed order will do
    ranked = running_sum(slots, ["key"], "bucket", [F.col("slot")], "one", "rank").select("key", "rank", "slot")
    n = F.lit(float(1 << k))  # a power of two: lo * n and hi * n are exact
    between = targets.where("hi > lo").where(F.ceil(F.col("lo") * n) == F.ceil(F.col("hi") * n))
    mirrored = F.conv(F.reverse(F.lpad(F.bin(F.floor(F.col("lo") * n)), max(k, 1), "0")), 2, 10).cast("long")
    return ranked.unionByName(between.select("key", F.lit(0).cast("long").alias("rank"), F.coalesce(mirrored, F.lit(0)).cast("long").alias("slot")))


def lines_taken(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, extra: tuple[str, ...] = (), slot_bits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The sources' lines (id, key, size, source_size, target, at, words, n_slots, taken) and the schedule's slots."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    # a null source sorts last: keys of named ones begin with "0", its own is "1"
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    rows = docs.select(
        F.col(id_col).alias("id"), key.alias("key"), n_words(text).alias("size"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("h"), F.xxhash64(text, F.lit(seed)).alias("h2"), *extra,
    )
    rows = stage(rows, "sizes")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights), "targets")
    slots = stage(schedule(spark, targets, slot_bits), "schedule")
    got = slots.groupBy("key").agg(F.count(F.lit(1)).alias("n_slots"))

    t = targets.join(got, "key", "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0)).cast("long"))
    # whole words between the ends of the interval: to one word the target, and over all sources the total
    words = F.rint(F.col("hi") * F.col("total")) - F.rint(F.col("lo") * F.col("total"))
    t = t.withColumn("words", F.greatest(F.lit(0), F.least(words.cast("long"), F.col("source_size") * MOST)))
    t = t.withColumn("parts", F.ceil(F.sqrt(F.col("docs").cast("double"))))
    t = t.select("key", "source_size", "target", "words", "n_slots", "parts")
    # a row for each source: few enough (counted) they are sent to all rows, and no source's rows meet in one task
    few = targets.count() <= BROADCAST_IDS
    line = rows.join(F.broadcast(t) if few else t, "key").withColumn("bucket", F.pmod("h", "parts"))
    line = line if few else line.repartition("key", "bucket")
    line = running_sum(line, ["key"], "bucket", [F.col("h"), F.col("id"), F.col("h2"), F.col("size")], "size", "at")
    laps = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    line = line.withColumn("taken", (laps * F.col("size") + part).cast("long"))
    return line, slots


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, extra: tuple[str, ...] = (), slot_bits: int | None = None,
) -> DataFrame:
    """Per document: id, size, source_size, target, taken, and the first slot that carries it (null: none).

    ``extra`` columns go along; they must not be named as one of these.
    """
    line, slots = lines_taken(docs, id_col, text_col, source_col, weights, seed, extra, slot_bits)
    # the block that the document's first word is in on the first lap: a source's words are n_slots equal blocks
    block = F.expr("(at * n_slots) div greatest(words, 1)")
    line = line.withColumn("rank", F.when(F.col("taken") > 0, block))
    first = slots.select(F.col("key").alias("sk"), F.col("rank").alias("sr"), F.col("slot").alias("first_slot"))
    out = line.join(first, (F.col("key") == F.col("sk")) & (F.col("rank") == F.col("sr")), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot", *extra)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all ``documents``, sources weighing 1, 2, 3 in turn."""
    return mix(read_table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in the order of the schedule's slots: whole copies, and where the target's
    end cuts one, its first words.

    The mix is planned on slim rows; texts are moved twice, to their places in the plan and into order. A copy goes to the slot of
    the block that its first word is in. Null texts and texts without a word are not taken; an empty table gives an empty mix.
    """
    cols = docs.columns
    own = "row_of_mix"
    while own in cols:
        own += "_"
    numbered = stage(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    line, slots = lines_taken(numbered, extra=(own,))
    whole, part = F.expr("taken div size").cast("int"), F.expr("taken % size")
    line = line.where("taken > 0").withColumn("whole", whole).withColumn("part", part)
    line = line.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole") - F.when(F.col("part") > 0, 0).otherwise(1))))
    line = line.withColumn("place", F.col("copy") * F.col("source_size") + F.col("at"))
    line = line.withColumn("rank", F.expr("least((place * n_slots) div greatest(words, 1), n_slots - 1)"))
    line = line.withColumn("part", F.when(F.col("copy") == F.col("whole"), F.col("part")))
    slots = slots.select(F.col("key").alias("sk"), F.col("rank").alias("sr"), "slot")
    # slots are 2**SLOT_BITS at least, too many to pass through the driver; a slot has few documents, so no row of theirs is hot
    plan = line.join(slots.hint("merge"), (F.col("key") == F.col("sk")) & (F.col("rank") == F.col("sr")), "left")
    plan = plan.select(F.col(own).alias("at_row"), F.struct("slot", "place", "key").alias("at_slot"), "part")
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    out = numbered.select(F.col(own).alias("at_row"), row).join(plan, "at_row")
    out = out.repartitionByRange("at_slot").sortWithinPartitions("at_slot")
    text = F.when(F.col("part").isNotNull(), _prefix(F.col("row.text"), F.col("part"))).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols])


def _prefix(text: Column, n: Column) -> Column:
    """The first n words, with the white space between them made one space."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.array_join(F.slice(words, 1, n.cast("int")), " ")

"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: all sizes are shared by weight (5, 2, 1 in turn over the sources by code point, null last); a source stops at
three times its size and the rest is shared anew, which is filling up to one level, found from running sums.

Schedule: slot i falls at the van der Corput point of i (its bits mirrored), which the cumulative targets map to a
source; a source's slots are ranked. Its documents, shuffled by a digest of their ids and repeated up to three times,
are cut into blocks of equal size, as many as fit its target; the block of each rank takes the slot of that rank.

No step puts a whole source in one task: running sums go over ranges of the digest first and within each range then.
Which ranges, and the number of slots, follow from the input's size.

Edge cases: null text has size 0; documents without words take nothing but stay; a null source is a source; repeated
rows and ids each have their own place; an empty table gives no row; extra columns are ignored; a source too small to
meet a slot has its one block at the schedule's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from damhwa.llm.common import discard, materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 2048
CELLS = 4096
RANGE_ROWS = 2048
BITS = 52
MOST_SOURCES_BROADCAST = 100_000


def words(text: Column) -> Column:
    """Number of [^ \\t-\\r]+ in the text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> those with target: one row a source, so a single window does."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    rows = sources.withColumn("weight", weight.cast("double")).withColumn("cap", (REPEATS * F.col("source_size")).cast("double"))
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # the first source, by cap over weight, that the level of what is left does not fill stands for all after it
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return rows.select("source", "source_size", "total", F.when(F.col("cap") <= F.coalesce("level", F.lit(0.0)) * F.col("weight"), F.col("cap")).otherwise(F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _running(df: DataFrame, keys: list[str], part: str, order: list, value: Column, name: str, by_source: DataFrame | None = None) -> DataFrame:
    """The sum of `value` over the rows before each, by keys, in order of (part, order); also `nth`, unique in a part.

    by_source: columns to add by `source`; they meet the parts first, so no join has a whole source's rows under one key.
    """
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in (*keys, part)], before.alias("_before"))
    if by_source is not None:
        more = by_source.withColumnRenamed("source", "_key")
        parts = parts.join(more, F.col("_source").eqNullSafe(F.col("_key"))).drop("_key")
    within = Window.partitionBy(*keys, part).orderBy(*order)
    rows = df.withColumn("nth", F.row_number().over(within)).withColumn(name, F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, part)]
    joined = rows.join(parts, on)
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_before", *[f"_{k}" for k in (*keys, part)])


def point(i: Column) -> Column:
    """The van der Corput point of i, below 2**52, in base 2: exact in a double."""
    return F.conv(F.reverse(F.lpad(F.bin(i), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)


def schedule(df: DataFrame, plan: DataFrame, slots: int) -> DataFrame:
    """(slot, source, rank) for `slots` slots; plan: (source, target, total)."""
    spark = df.sparkSession
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    high = F.sum("target").over(order) / F.sum("target").over(Window.partitionBy(F.lit(0)))
    spans = plan.where("target > 0").withColumn("high", high)
    spans = spans.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("high", F.when(F.lead("high").over(order).isNull(), F.lit(1.0)).otherwise(F.col("high")))
    cell = lambda u: F.floor(u * CELLS).cast("int")
    spans = spans.select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(CELLS - 1)))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    met = points.join(spans, "cell").where("u >= low AND u < high").select("slot", "source", F.expr("slot div 4096").alias("stretch"))
    return _running(met, ["source"], "stretch", [F.col("slot")], F.lit(1), "rank").select("slot", "source", "rank")


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("digest"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of each row; first_slot is -1 where nothing is taken.

    Two numbers reach the driver: rows and words of the whole input.
    """
    return _mixed(df, id_col, text_col, source_col, block_words).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot")


def _mixed(df: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int) -> DataFrame:
    """What `mix` returns, with id and source."""
    rows = sized(df, id_col, text_col, source_col)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n, total = sources.agg(F.sum("n"), F.sum("source_size")).first()
    ranges, slots = max(1, (n or 0) // RANGE_ROWS), max(1024, -(-(total or 0) // block_words))
    plan = targets(sources.drop("n"))
    order = schedule(df, plan, slots)
    counts = order.groupBy("source").agg(F.count("*").alias("slots"))
    take = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "total")
    plan = plan.withColumn("take", take).withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("take") / F.coalesce("slots", F.lit(1)))).cast("long")).drop("slots")
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("int"))
    rows = _running(rows, ["source"], "range", [F.col("digest"), F.col("id"), F.col("size")], F.col("size"), "offset", plan).drop("digest")
    # the words of each repeat that are taken, and the blocks they lie in
    begin = lambda r: F.col("offset") + r * F.col("source_size")
    repeats = F.filter(F.array(*[F.struct(begin(r).alias("start"), F.least(begin(r) + F.col("size"), F.col("take")).alias("stop")) for r in map(F.lit, range(REPEATS))]), lambda x: x["start"] < x["stop"])
    pieces = rows.select("id", "source", "size", "source_size", "target", "block", "range", "nth", F.explode_outer(repeats).alias("part"))
    blocks = F.when(F.col("part").isNotNull(), F.sequence(F.expr("part.start div block"), F.expr("(part.stop - 1) div block")))
    pieces = pieces.select("*", F.explode_outer(blocks).alias("piece"))
    taken = F.least(F.col("part.stop"), (F.col("piece") + 1) * F.col("block")) - F.greatest(F.col("part.start"), F.col("piece") * F.col("block"))
    met = pieces.join(order.select("slot", F.col("source").alias("_s"), F.col("rank").alias("_r")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_r")), "left")
    return met.groupBy("source", "range", "nth", "id", "size", "source_size", "target").agg(F.coalesce(F.sum(taken), F.lit(0)).cast("long").alias("taken"), F.coalesce(F.min(F.when(F.col("piece").isNotNull(), F.coalesce("slot", F.lit(slots)))), F.lit(-1)).alias("first_slot"))


def _place(id_: Column) -> Column:
    """Where a document stands in its source, as `mix` orders by; size comes after."""
    return F.struct(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")).alias("digest"), id_.alias("id"))


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `df` with words, with `whole` and `rest`: how often the mix takes the text whole, and how many of its
    first words once more.

    The mix takes a source's documents in one order, over and over, up to some place, so the document there says of all
    others how often they come: one row a source is sent to the texts, which are not shuffled. Documents of one id and
    size in that place share what is taken of them, in the order of a hash of the text; only their texts are.
    """
    taken = materialize(_mixed(df, id_col, text_col, source_col, block_words).where("size > 0").select("source", "id", "size", "source_size", "taken"), "mix-taken")
    rounds = materialize(taken.groupBy(F.col("source").alias("_s")).agg(F.expr("sum(taken) div first(source_size)").alias("_rounds")), "mix-rounds")
    few = rounds.count() <= MOST_SOURCES_BROADCAST
    sent = lambda table: F.broadcast(table) if few else table
    of = F.col("source").eqNullSafe(F.col("_s"))
    more = F.expr("taken - _rounds * size")
    last = taken.join(sent(rounds), of).where(more > 0).groupBy("_s").agg(F.max(F.struct(_place(F.col("id")).alias("place"), "size")).alias("_last"))
    last = materialize(rounds.join(last.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "_rounds", "_last.place", F.col("_last.size").alias("_size")), "mix-last")
    there = taken.join(sent(last), of & (F.col("size") == F.col("_size")) & F.col("id").eqNullSafe(F.col("place.id"))).groupBy("_s").agg(F.sum(more).alias("_more"), F.count("*").alias("_n"))
    ends = materialize(last.join(there.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t").withColumnRenamed("place", "_last"), "mix-ends")
    discard(taken, rounds, last)
    here, size = _place(F.col(id_col)), words(F.col(text_col))
    met = df.where(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")).join(sent(ends), F.col(source_col).eqNullSafe(F.col("_s")))
    same = F.col("_last").isNotNull() & (here["digest"] == F.col("_last.digest")) & here["id"].eqNullSafe(F.col("_last.id"))
    met = met.withColumn("_at", F.when(same, F.signum(size - F.col("_size")).cast("int")).when(here < F.col("_last"), -1).otherwise(1)).withColumn("_nth", F.lit(1))
    if ends.where("_n > 1").limit(1).count():
        tied = (F.col("_at") == 0) & (F.col("_n") > 1)
        nth = F.row_number().over(Window.partitionBy("_s").orderBy(F.xxhash64(text_col), text_col))
        met = met.where(~tied).unionByName(met.where(tied).withColumn("_nth", nth))
    left = "greatest(0, least(_size, _more - (_nth - 1) * _size))"  # words taken of this one beyond its rounds
    whole = F.expr(f"_rounds + case when _at < 0 then 1 when _at = 0 then {left} div _size else 0 end").cast("int")
    return met.select(*df.columns, whole.alias("whole"), F.expr(f"if(_at = 0, {left} % _size, 0)").cast("int").alias("rest"))

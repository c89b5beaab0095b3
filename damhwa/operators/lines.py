"""Dialogue items to numbered lines, and metrics of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from damhwa.functions import text as T

METRICS = ("nfc_chars", "chars_without_whitespace", "utf8_bytes", "neis_bytes")


def item_text(line: str = "line", text: str = "text", content: str = "content") -> Column:
    """Structured items: the first of three fields that is not empty."""
    first = [F.nullif(F.col(c), F.lit("")) for c in (line, text, content)]
    return F.coalesce(*first, F.lit(""))


def lines(items: DataFrame, pattern: str = T.HINT_BREAK, strip_speakers: bool = True) -> DataFrame:
    """lines(scene_id, line_index, raw, line) of items(scene_id, item_idx, item); index from 1 within a scene.

    A line that is only a speaker's name stays, empty. Null items have no lines.
    """
    rows = items.where("item is not null").select("scene_id", "item_idx", F.posexplode(T.split_lines(F.col("item"), pattern)).alias("pos", "raw"))
    order = Window.partitionBy("scene_id").orderBy("item_idx", "pos")
    line = T.strip_speaker(F.col("raw")) if strip_speakers else F.col("raw")
    return rows.select("scene_id", F.row_number().over(order).alias("line_index"), "raw", line.alias("line"))


def line_metrics(df: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """Five sizes of each line, never the line itself."""
    rows = df.select(*keys, T.nfc(F.col(line)).alias("nfc"))
    n = F.col("nfc")
    return rows.select(*keys, F.length(n).alias("nfc_chars"), T.chars_without_space(n).alias("chars_without_whitespace"), F.octet_length(n).alias("utf8_bytes"), T.neis_bytes(n).alias("neis_bytes"))


def text_metrics(df: DataFrame, *keys: str, text: str = "text", strip_speakers: bool = True) -> DataFrame:
    """Metrics of each row's whole text: a narrow map over its array of lines, without a shuffle.

    Line sizes are summed, averaged (one decimal) and maximised; the total of neis_bytes also counts two bytes for each
    line break. Null and empty texts have zeros.
    """
    whole = T.nfc(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(*keys, whole.alias("whole")).withColumn("breaks", T.break_count(F.col("whole")))
    strip = T.strip_speaker if strip_speakers else lambda x: x
    rows = rows.withColumn("lines", F.transform(T.split_lines(F.col("whole")), strip))
    size = {"nfc_chars": F.length, "chars_without_whitespace": T.chars_without_space, "utf8_bytes": F.octet_length, "neis_bytes": T.neis_bytes}
    rows = rows.select(*keys, "breaks", F.size("lines").alias("line_count"), *[F.transform("lines", f).alias(k) for k, f in size.items()])
    return rollup(rows, *keys)


def rollup(rows: DataFrame, *keys: str) -> DataFrame:
    total = lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x)
    out = [F.col("line_count").cast("long").alias("line_count"), F.col("breaks").cast("long").alias("line_breaks")]
    for k in METRICS:
        more = 2 * F.col("breaks") if k == "neis_bytes" else F.lit(0)
        mean = F.when(F.col("line_count") > 0, F.round(total(k) / F.col("line_count"), 1)).otherwise(F.lit(0.0))
        out += [(total(k) + more).cast("long").alias(f"total_{k}"), mean.alias(f"avg_{k}"), F.coalesce(F.array_max(k), F.lit(0)).cast("long").alias(f"max_{k}")]
    return rows.select(*keys, *out)


def scene_metrics(items: DataFrame, strip_speakers: bool = True) -> DataFrame:
    """Metrics of scenes whose items are rows: sizes of lines first, then one shuffle by scene.

    Scenes without a line have zeros.
    """
    item = items.select("scene_id", T.nfc(F.coalesce("item", F.lit(""))).alias("item"))
    strip = T.strip_speaker if strip_speakers else lambda x: x
    rows = item.select("scene_id", T.break_count(F.col("item")).alias("breaks"), F.transform(T.split_lines(F.col("item")), strip).alias("lines"))
    size = {"nfc_chars": F.length, "chars_without_whitespace": T.chars_without_space, "utf8_bytes": F.octet_length, "neis_bytes": T.neis_bytes}
    each = rows.select("scene_id", "breaks", F.size("lines").alias("n"), *[F.transform("lines", f).alias(k) for k, f in size.items()])
    total = lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x)
    agg = each.groupBy("scene_id").agg(F.sum("n").alias("line_count"), F.sum("breaks").alias("line_breaks"), *[F.sum(total(k)).alias(f"s_{k}") for k in METRICS], *[F.max(F.array_max(k)).alias(f"m_{k}") for k in METRICS])
    out = []
    for k in METRICS:
        more = 2 * F.col("line_breaks") if k == "neis_bytes" else F.lit(0)
        out += [(F.col(f"s_{k}") + more).alias(f"total_{k}"), F.when(F.col("line_count") > 0, F.round(F.col(f"s_{k}") / F.col("line_count"), 1)).otherwise(F.lit(0.0)).alias(f"avg_{k}"), F.coalesce(F.col(f"m_{k}"), F.lit(0)).cast("long").alias(f"max_{k}")]
    return agg.select("scene_id", "line_count", F.col("line_breaks").cast("long").alias("line_breaks"), *out)

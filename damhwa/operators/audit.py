"""One packet a scene: metrics, calibration, naturalness and guidance together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from damhwa.operators import features as X
from damhwa.operators import guidance as G
from damhwa.operators import hints as H
from damhwa.operators.lines import lines


def audit(items: DataFrame, scenes: DataFrame, bank: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(scene_id, line_count, total_chars, calibration, naturalness, guidance), the last three arrays of structs.

    bank: (sizes, rates, counts) as `guidance` takes them. Line features are computed once for all parts.
    """
    features = X.line_features(lines(items)).cache()
    sizes = features.groupBy("scene_id").agg(F.count("*").alias("line_count"), F.sum("chars").alias("total_chars"))
    out = scenes.select("scene_id").join(sizes, "scene_id", "left").fillna(0, ["line_count", "total_chars"])
    parts = {
        "calibration": H.calibration_hints(features, scenes),
        "naturalness": H.naturalness_hints(features, scenes),
        "guidance": G.guidance(G.scene_matches(features, scenes), *(bank or (None, None, None))),
    }
    for name, rows in parts.items():
        fields = [c for c in rows.columns if c != "scene_id"]
        listed = rows.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(listed, "scene_id", "left")
    return out

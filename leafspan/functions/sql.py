"""The expressions of this package as SQL functions of a session. They are SQL bodies that Catalyst inlines, no Python runs for them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOXES = "ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE"
_OX, _OY = "(least(ax1, bx1) - greatest(ax0, bx0))", "(least(ay1, by1) - greatest(ay0, by0))"
_UNION = f"((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - {_OX} * {_OY})"
#: Name -> (parameters, type, body).
FUNCTIONS = {
    "box_iou": (_BOXES, "DOUBLE", f"CASE WHEN {_OX} > 0 AND {_OY} > 0 AND {_UNION} > 0 THEN {_OX} * {_OY} / {_UNION} ELSE 0D END"),
    "box_gap_x": (_BOXES, "DOUBLE", f"greatest(-{_OX}, 0D)"),
    "box_gap_y": (_BOXES, "DOUBLE", f"greatest(-{_OY}, 0D)"),
    "box_contains": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, px DOUBLE, py DOUBLE", "BOOLEAN", "px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1"),
    "word_core": ("t STRING", "STRING", "btrim(t, '.,;:!?()[]{}\"\\'')"),
    "text_similarity": ("a STRING, b STRING", "DOUBLE", "CASE WHEN greatest(length(a), length(b)) > 0 THEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) ELSE 1D END"),
    "digit_share": ("t STRING", "DOUBLE", "CASE WHEN length(t) > 0 THEN regexp_count(t, '[0-9]') / length(t) ELSE 0D END"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions of this module known to ``spark`` as temporary functions and gives their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)

"""Scalar expressions against hand-worked values."""

import pytest
from pyspark.sql import functions as F

from leafspan.functions import geometry as G
from leafspan.functions import text as X
from leafspan.operators.entities import entity_of
from leafspan.operators.sanitize import ocr_factor


def one(spark, expr, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(expr.alias("v")).first()["v"]


def test_iou_and_gaps(spark):
    box = dict(a_x0=0.0, a_y0=0.0, a_x1=10.0, a_y1=10.0, b_x0=5.0, b_y0=5.0, b_x1=15.0, b_y1=15.0)
    assert one(spark, G.iou("a_", "b_"), **box) == pytest.approx(25 / 175)
    assert one(spark, G.iou("a_", "b_"), **(box | dict(b_x0=10.0))) == 0
    assert one(spark, G.gap("a_", "b_", "x"), **(box | dict(b_x0=13.0))) == 3
    assert one(spark, G.overlap_ratio("a_", "b_", "y"), **box) == 0.5
    assert one(spark, G.overlap_ratio("a_", "b_", "x"), **(box | dict(b_x0=15.0))) == 0


@pytest.mark.parametrize("angle,want", [(0, (1, 2, 3, 5)), (90, (95, 1, 98, 3)), (180, (97, 195, 99, 198)), (270, (2, 197, 5, 199))])
def test_rotation(spark, angle, want):
    row = spark.createDataFrame([(angle, 1.0, 2.0, 3.0, 5.0)], "a int, x0 double, y0 double, x1 double, y1 double").select(*G.rotated_back(F.col("a"), F.lit(100.0), F.lit(200.0))).first()
    assert tuple(row) == want


def test_rotation_refuses_other_angles(spark):
    row = spark.createDataFrame([(45, 1.0, 2.0, 3.0, 5.0)], "a int, x0 double, y0 double, x1 double, y1 double")
    with pytest.raises(Exception, match="rotation"):
        row.select(*G.rotated_back(F.col("a"), F.lit(100.0), F.lit(200.0))).collect()


@pytest.mark.parametrize("text,want", [("hello-world", "Hello-World"), ("don't", "Don'T"), ("ÉCOLE", "École"), ("", "")])
def test_title(spark, text, want):
    assert one(spark, X.title_case(F.col("t")), t=text) == want


@pytest.mark.parametrize("word,model,want", [("file", "FILE1", "FILE"), ("File", "filel", "file"), ("file", "Filel", "File"), ("file", "fIlE", "file"), ("file", "123", "file")])
def test_case_transfer(spark, word, model, want):
    assert one(spark, X.like_case(F.col("w"), F.col("m")), w=word, m=model) == want


@pytest.mark.parametrize("text,want", [("a", True), ("word", False), ("x@y", False), ("$$--a", True), ("bcdfg", True), ("ImLIudz", True), ("Hello", False)])
def test_garbage(spark, text, want):
    assert one(spark, X.garbage(F.col("t")), t=text) is want


def test_edges(spark):
    assert one(spark, F.concat_ws("|", X.prefix_of(F.col("t")), X.core_of(F.col("t")), X.suffix_of(F.col("t"))), t='("word).') == '("|word|).'
    assert one(spark, F.concat_ws("|", X.prefix_of(F.col("t")), X.core_of(F.col("t")), X.suffix_of(F.col("t"))), t="...") == "...||"


@pytest.mark.parametrize("rel,want", [(0.0, "ab"), (0.5, "cde"), (0.99, "f")])
def test_word_at(spark, rel, want):
    assert one(spark, X.word_at(F.col("t"), F.lit(rel)), t="ab cde f") == want


@pytest.mark.parametrize("text,want", [("7/24/25", "DATE"), ("12-31-2024,", "DATE"), ("2024-12-31", "DATE"), ("555-123-4567", "CODE"), ("123-45-6789", "CODE"), ("7829341", "CODE"), ("A1234567", "CODE"), ("10:28", ""), ("$1,000.00", ""), ("50%", ""), ("mrn", ""), ("Intake", ""), ("", ""), ("Abigail", "NAME")])
def test_entities(spark, text, want):
    assert one(spark, entity_of(F.col("t"), F.col("t") == "Abigail"), t=text) == want


def test_ocr_factor(spark):
    assert one(spark, ocr_factor(F.col("a"), F.col("b")), a="fi1e", b="file") == pytest.approx(1 + 0.9 * 0.4)
    assert one(spark, ocr_factor(F.col("a"), F.col("b")), a="modem", b="modern") == pytest.approx(1 + (0.85 * 0.8) ** 0.5 * 0.4 - 0.4)
    assert one(spark, ocr_factor(F.col("a"), F.col("b")), a="abc", b="abd") == 1.0

"""The word tables as the operators take them, in Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.sources import table

BOX = ["x0", "y0", "x1", "y1"]


def engine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engine_words, each row once, with one spelling of an engine's name and confidences from 0 to 100."""
    c = F.coalesce("confidence", F.lit(0.0))
    return table(spark, sf_dir, "engine_words").select(
        "file_id", "page", "word_id", F.lower(F.trim("engine")).alias("engine"), "idx", F.coalesce("text", F.lit("")).alias("text"), *BOX, F.when(c <= 1, c * 100).otherwise(c).alias("confidence")
    ).distinct()


def harmonized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """harmonized_words, each word once."""
    engines = [f"{p}_{e}" if p == "dist" else f"{e}_text" for p in ("text", "dist") for e in ("tess", "easy", "doctr", "paddle", "surya")]
    return table(spark, sf_dir, "harmonized_words").select("file_id", "word_id", "page", *BOX, F.coalesce("text", F.lit("")).alias("text"), "status", F.upper(F.coalesce("source", F.lit(""))).alias("source"), F.coalesce("conf", F.lit(0.0)).alias("conf"), "rotation", *engines).distinct()


def slim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words_slim, each word once, with confidence and engine filled."""
    return table(spark, sf_dir, "words_slim").select("file_id", "page", "word_id", F.coalesce("text", F.lit("")).alias("text"), *BOX, F.coalesce("engine", F.lit("")).alias("engine"), F.coalesce("ocr_confidence", F.lit(0.0)).alias("confidence")).distinct()


EW = """ew AS (SELECT DISTINCT file_id, page, word_id, lower(trim(engine)) AS engine, idx, coalesce(text, '') AS text, x0, y0, x1, y1,
  CASE WHEN coalesce(confidence, 0) <= 1 THEN coalesce(confidence, 0) * 100 ELSE confidence END AS confidence FROM engine_words)"""
HW = """hw AS (SELECT DISTINCT file_id, word_id, page, x0, y0, x1, y1, coalesce(text, '') AS text, status, upper(coalesce(source, '')) AS source, coalesce(conf, 0) AS conf, rotation,
  tess_text, easy_text, doctr_text, paddle_text, surya_text, dist_tess, dist_easy, dist_doctr, dist_paddle, dist_surya FROM harmonized_words)"""
SW = """sw AS (SELECT DISTINCT file_id, page, word_id, coalesce(text, '') AS text, x0, y0, x1, y1, coalesce(engine, '') AS engine, coalesce(ocr_confidence, 0) AS confidence FROM words_slim)"""
#: The core of a text and its signs, as leafspan.functions.text has them.
EDGE = ".,;:?!()[]{}\"''"


def core(t: str) -> str:
    return f"trim({t}, '{EDGE}')"

"""Tagging of dates, codes and names, redaction statistics and what is to be drawn over a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.functions import patterns as P
from leafspan.functions.text import strip_edges

#: Colours of the overlay by entity.
COLOURS = {"NAME": "#FF6B6B", "DATE": "#4ECDC4", "CODE": "#FFE66D", "": "#95A5A6"}


def entity_of(text: Column, is_name: Column, dates: bool = True, codes: bool = True, names: bool = True) -> Column:
    """DATE, CODE, NAME or "": blank texts and exceptions (times, amounts, shares, abbreviations) have none."""
    t = F.trim(text)
    e = F.when(t.isNull() | (t == "") | P.matches(t, P.EXCEPTIONS), "")
    if dates:
        e = e.when(P.matches(t, P.DATES), "DATE")
    if codes:
        e = e.when(P.matches(t, P.CODES), "CODE")
    if names:
        e = e.when(is_name, "NAME")
    return e.otherwise("")


def tag_entities(words: DataFrame, names: DataFrame, text: str = "text", name: str = "name", **switches: bool) -> DataFrame:
    """``words`` with entity and redact. ``names`` holds one name a row; it is looked up without edge signs and case.

    The list is joined by its lower-case form; Spark broadcasts it while it is small and shuffles it otherwise.
    """
    known = names.select(F.lower(F.trim(F.col(name))).alias("_name")).where("_name <> ''").distinct()
    key = F.lower(strip_edges(F.coalesce(F.col(text), F.lit(""))))
    tagged = words.withColumn("_key", key).join(known.withColumn("_hit", F.lit(True)), F.col("_key") == F.col("_name"), "left")
    entity = entity_of(F.col(text), F.coalesce("_hit", F.lit(False)), **switches)
    return tagged.withColumn("entity", entity).withColumn("redact", F.col("entity") != "").drop("_key", "_name", "_hit")


def redaction_stats(tagged: DataFrame) -> DataFrame:
    """One row: total, redacted, and the words of each entity."""
    of = lambda e: F.count_if(F.col("entity") == e).alias(f"n_{e.lower()}")
    return tagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("redact").alias("redacted"), of("NAME"), of("DATE"), of("CODE"))


def draw_list(tagged: DataFrame, padding: float = 2.0, preview: bool = False) -> DataFrame:
    """The rectangles of redacted words, padded, with mode (fill or outline) and colour."""
    colour = F.lit(COLOURS[""])
    for e, c in COLOURS.items():
        colour = F.when(F.col("entity") == e, c).otherwise(colour)
    box = [(F.col(s) + (padding if s[1] == "1" else -padding)).alias(s) for s in ("x0", "y0", "x1", "y1")]
    return tagged.where("redact").select("file_id", "page", "word_id", *box, F.lit("outline" if preview else "fill").alias("mode"), (colour if preview else F.lit("#000000")).alias("colour"))


def boxes_by_page(tagged: DataFrame) -> DataFrame:
    """The redacted boxes of each page as an array in word order."""
    box = F.struct("word_id", "x0", "y0", "x1", "y1")
    return tagged.where("redact").groupBy("file_id", "page").agg(F.array_sort(F.collect_list(box)).alias("boxes"))

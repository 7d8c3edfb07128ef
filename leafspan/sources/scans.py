"""Rows of recognition engines in their own shapes, brought to words with boxes in points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions.text import tokens

WORD_SCHEMA = "page bigint, word_id bigint, text string, x0 double, y0 double, x1 double, y1 double, engine string, ocr_confidence double"


def polygon_box(xs: Column, ys: Column) -> list[Column]:
    """The box of a polygon given as arrays of coordinates."""
    return [F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")]


def nested_words(pages: DataFrame) -> DataFrame:
    """file_id, page, idx, text, box, confidence of an engine that nests words in lines, blocks and pages, with corners as shares of the page and confidences from 0 to 1.

    ``pages`` has file_id, page, width, height and blocks: array<struct<lines: array<struct<words: array<struct<value, geometry, confidence>>>>>>.
    """
    lines = pages.select("file_id", "page", "width", "height", F.posexplode("blocks").alias("b", "block")).select("*", F.posexplode("block.lines").alias("l", "line"))
    w = lines.select("file_id", "page", "width", "height", "b", "l", F.posexplode("line.words").alias("k", "word"))
    corner = lambda i, axis: F.col("word.geometry")[i][axis] * F.col(("width", "height")[axis])
    idx = F.row_number().over(Window.partitionBy("file_id", "page").orderBy("b", "l", "k")) - 1
    return w.select("file_id", "page", idx.cast("bigint").alias("idx"), F.col("word.value").alias("text"), corner(0, 0).alias("x0"), corner(0, 1).alias("y0"), corner(1, 0).alias("x1"), corner(1, 1).alias("y1"), (F.col("word.confidence") * 100).alias("confidence")).where("trim(text) <> ''")


def scaled_words(rows: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """Words of an engine that works in pixels: trimmed, without blank texts and negative confidences, in points."""
    box = [(F.col(c) * (scale_x if c[0] == "x" else scale_y)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    rest = [c for c in rows.columns if c not in ("text", "x0", "y0", "x1", "y1")]
    return rows.where((F.trim("text") != "") & (F.col("confidence") >= 0)).select(*rest, F.trim("text").alias("text"), *box)


def _split_words(lines: DataFrame, key: str) -> DataFrame:
    words = lines.withColumn("_words", tokens(F.col("text"))).where(F.size("_words") > 0)
    words = words.withColumn("_n", F.size("_words")).withColumn("_len", F.aggregate("_words", F.lit(0), lambda s, w: s + F.length(w)))
    return words.select("*", F.posexplode("_words").alias("part", "word"))


def split_by_width(lines: DataFrame, key: str = "word_id") -> DataFrame:
    """key, part, text, box: lines of several words cut in proportion, a word of n letters taking n + 1/4 of the letters plus half of the spaces."""
    w = _split_words(lines, key)
    share = (F.length("word") + 0.25) / (F.col("_len") + 0.5 * (F.col("_n") - 1))
    w = w.withColumn("_w", F.when(F.col("_n") > 1, share * (F.col("x1") - F.col("x0"))).otherwise(F.col("x1") - F.col("x0")))
    run = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("x0") + F.coalesce(F.sum("_w").over(run), F.lit(0.0))
    return w.select(key, F.col("part").cast("bigint").alias("part"), F.col("word").alias("text"), start.alias("x0"), "y0", F.least(start + F.col("_w"), F.col("x1")).alias("x1"), "y1")


def split_by_letters(lines: DataFrame, key: str = "word_id") -> DataFrame:
    """key, part, text, box: lines cut by letters, with one letter's width for each space, held to the line's end."""
    w = _split_words(lines, key).withColumn("_c", (F.col("x1") - F.col("x0")) / (F.col("_len") + F.col("_n") - 1))
    run = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("word") + 1).over(run), F.lit(0))
    start = F.least(F.col("x0") + F.col("_c") * before, F.col("x1"))
    return w.select(key, F.col("part").cast("bigint").alias("part"), F.col("word").alias("text"), start.alias("x0"), "y0", F.least(start + F.col("_c") * F.length("word"), F.col("x1")).alias("x1"), "y1")


def words_of_characters(chars: DataFrame, line: str = "line_id") -> DataFrame:
    """line, word_no, text, box, confidence: runs of characters between white space; confidence is the mean of the characters' times 100.

    ``chars`` has line, pos, char, x0, y0, x1, y1, conf (0 to 1).
    """
    w = Window.partitionBy(line).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.col("char").rlike(r"^\s*$")
    c = chars.withColumn("_word", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank)
    words = c.groupBy(line, "_word").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.avg("conf") * 100).alias("confidence"),
    )
    return words.withColumn("word_no", F.row_number().over(Window.partitionBy(line).orderBy("_word")).cast("bigint") - 1).drop("_word")


def ctc_decoded(steps: DataFrame, key: str, blank: str = "") -> DataFrame:
    """key, text, confidence: greedy decoding of (key, step, symbol, prob): blanks and repeats fall away; confidence is the geometric mean of what is kept."""
    w = Window.partitionBy(key).orderBy("step")
    kept = steps.withColumn("_last", F.lag("symbol").over(w)).where((F.col("symbol") != blank) & (F.col("_last").isNull() | (F.col("_last") != F.col("symbol"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "symbol"))), lambda x: x["symbol"]), "").alias("text"), F.exp(F.avg(F.log(F.greatest("prob", F.lit(1e-10))))).alias("confidence"))

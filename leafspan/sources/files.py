"""CSV, JSON, word lists and folders of documents, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.sources.scans import WORD_SCHEMA

HARMONIZED_SCHEMA = "word_id bigint, page bigint, x0 double, y0 double, x1 double, y1 double, text string, status string, source string, conf double, rotation bigint, tess string, easy string, doctr string, paddle string, surya string"
ENGINE_LETTERS = {"tess": "T", "easy": "E", "doctr": "D", "paddle": "P", "surya": "S"}


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Plain words (true or found) of a CSV with header; null texts and engines become empty."""
    return spark.read.csv(path, header=True, schema=WORD_SCHEMA, multiLine=True, escape='"').na.fill("", ["text", "engine"])


def read_harmonized(spark: SparkSession, path: str) -> DataFrame:
    """Harmonised words of a CSV with header; blanks take their defaults (0 for numbers, "" for texts)."""
    return spark.read.csv(path, header=True, schema=HARMONIZED_SCHEMA, enforceSchema=False, multiLine=True, escape='"').na.fill(0.0, ["conf"]).na.fill(0, ["rotation"]).na.fill("")


def read_redactions(spark: SparkSession, path: str, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """``by``, boxes: the boxes of rows whose redact is "true", by page (and file, where files are read together)."""
    rows = spark.read.csv(path, header=True).where(F.lower(F.trim("redact")) == "true")
    box = F.struct(F.col("word_id").cast("bigint").alias("word_id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return rows.groupBy(*[F.col(c).cast("bigint").alias(c) for c in by]).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def read_dictionary(spark: SparkSession, path: str, name: str, frequencies: bool = False, min_length: int = 1, min_frequency: int = 0) -> DataFrame:
    """dictionary, term, term_lower of a word list, or of lines of word and frequency; lines that begin with # are comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    parts = F.split("v", r"[,\t]")
    term = F.trim(F.get(parts, F.lit(0))) if frequencies else F.col("v")
    n = F.coalesce(F.try_to_number(F.trim(F.get(parts, F.lit(1))), F.lit("999999999999")).cast("bigint"), F.lit(0))
    kept = lines.select(term.alias("term"), *([n.alias("n")] if frequencies else [])).where(F.length("term") >= min_length)
    if frequencies:
        kept = kept.where(F.col("n") >= min_frequency)
    return kept.select(F.lit(name).alias("dictionary"), "term", F.lower("term").alias("term_lower")).distinct()


def read_counts(spark: SparkSession, path: str, words: int = 1) -> DataFrame:
    """w1[, w2], n of lines of one or two words, a tab and a count."""
    v = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(F.split("value", r"\t").alias("p"))
    pair = F.split(F.trim(F.get("p", F.lit(0))), r"\s+")
    names = [F.lower(F.get(pair, F.lit(i))).alias(f"w{i + 1}") for i in range(words)]
    return v.select(*names, F.get("p", F.lit(1)).cast("bigint").alias("n")).where(F.col(f"w{words}").isNotNull() & F.col("n").isNotNull())


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name of every line of a list of names: the whole line in lower case, without comments."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def list_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modificationTime of the documents below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def harmonized_rows(words: DataFrame, distances: bool = False, pixel: bool = True) -> DataFrame:
    """The columns of the harmonised CSV: coordinates with two decimals, confidence with one, absent distances (-1) blank."""
    w = words if pixel else words.where(F.coalesce("status", F.lit("")) != "pixel")
    cols: list[Column] = [F.col("word_id"), F.col("page"), *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")], F.coalesce("text", F.lit("")).alias("text"), F.col("status"), F.coalesce("source", F.lit("")).alias("source"), F.round("conf", 1).alias("conf"), F.col("rotation")]
    cols += [F.coalesce(f"{e}_text", F.lit("")).alias(e) for e in ENGINE_LETTERS]
    if distances:
        cols += [F.when(F.col(f"dist_{e}") >= 0, F.col(f"dist_{e}")).alias(f"dist_{e}") for e in ENGINE_LETTERS]
    return w.select(*cols)


def document_rows(words: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, page, json: a page as one JSON object (page_number, width, height, words with box, engine and confidence), under its file's name.

    A page a row: a document of any length is never gathered in one task.
    """
    size = pages.groupBy("file_id", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    name = files.groupBy("file_id").agg(F.max("filename").alias("filename"))
    engine = F.when(F.coalesce("engine", F.lit("")) == "", "harmonized").otherwise(F.col("engine"))
    w = words.select("file_id", "page", F.struct("word_id", F.coalesce("text", F.lit("")).alias("text"), F.array("x0", "y0", "x1", "y1").alias("bbox"), engine.alias("engine"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).alias("w"))
    page = w.groupBy("file_id", "page").agg(F.array_sort(F.collect_list("w")).alias("words")).join(size, ["file_id", "page"], "left").join(name, "file_id", "left")
    body = F.struct("filename", F.col("page").alias("page_number"), "width", "height", "words")
    return page.select("file_id", "page", F.to_json(body).alias("json"), F.size("words").cast("bigint").alias("total_words"))


def write(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes rows as csv (with header) or json; other kinds are refused."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no such format: {kind}")
    w = rows.write.mode("overwrite")
    w.csv(path, header=True, quoteAll=False, escape='"') if kind == "csv" else w.format(kind).save(path)


def redacted_rows(tagged: DataFrame) -> DataFrame:
    """Words with entity and redact as their CSV has them; redact is "true" or "false"."""
    return tagged.withColumn("redact", F.when(F.col("redact"), "true").otherwise("false"))


def word_list_json(terms: DataFrame, by: str = "dictionary", term: str = "term") -> DataFrame:
    """``by``, letter, json: the terms of a list as JSON arrays in order, one for each first letter, so that no list is gathered whole."""
    t = terms.select(by, F.lower(F.substr(term, F.lit(1), F.lit(1))).alias("letter"), term).distinct()
    return t.groupBy(by, "letter").agg(F.to_json(F.sort_array(F.collect_list(term))).alias("json"))


def lines_json(lines: DataFrame) -> DataFrame:
    """file_id, page, line, json of reconstructed lines: line_id, text and bbox."""
    box = F.struct("x0", "y0", "x1", "y1")
    return lines.select("file_id", "page", "line", F.to_json(F.struct(F.col("line").alias("line_id"), "text", box.alias("bbox"))).alias("json"))


def response_rows(words: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, page, json: a page of the answer of a service: filename, total_words of the file, page_number, width, height, words with bbox as an object.

    A page a row, with the file's total on each, for the caller to stream.
    """
    total = words.groupBy("file_id").agg(F.count(F.lit(1)).alias("total_words"))
    size = pages.groupBy("file_id", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    name = files.groupBy("file_id").agg(F.max("filename").alias("filename"))
    w = F.struct("word_id", F.coalesce("text", F.lit("")).alias("text"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), "page", "engine", "confidence")
    page = words.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(w)).alias("words")).join(size, ["file_id", "page"], "left").join(name, "file_id", "left").join(total, "file_id")
    return page.select("file_id", "page", "total_words", F.to_json(F.struct("filename", "total_words", F.col("page").alias("page_number"), "width", "height", "words")).alias("json"))


def upright(box: DataFrame, page_height: Column) -> DataFrame:
    """Boxes in the space of PDF drawing, whose origin is at the bottom."""
    return box.withColumn("_y0", page_height - F.col("y1")).withColumn("y1", page_height - F.col("y0")).withColumn("y0", F.col("_y0")).drop("_y0")


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with number: 0, 1, ... over each file in (page, y, x) order.

    Pages are numbered on their own and then shifted by the words of the pages before, so that a long file is not sorted in one task.
    """
    inner = Window.partitionBy("file_id", "page").orderBy("y0", "x0", "word_id")
    count = words.groupBy("file_id", "page").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    shift = count.select("file_id", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    return words.withColumn("_i", F.row_number().over(inner) - 1).join(shift, ["file_id", "page"]).withColumn("number", (F.col("_shift") + F.col("_i")).cast("bigint")).drop("_i", "_shift")

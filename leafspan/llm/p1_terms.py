"""Problem 1: how often every distinct term occurs, in how many records, and which terms are too rare or too common.

Per-record term counts are combined by hash before each shuffle; the sums of occurrences and records are exact.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspan.sources import table


def canonical_term(text: str | None) -> str | None:
    """NFKC, without Cf, lower case, less edge characters outside L* and N*; None if nothing is left."""
    if text is None:
        return None
    t = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").lower()
    i, j = 0, len(t)
    while i < j and unicodedata.category(t[i])[0] not in "LN":
        i += 1
    while j > i and unicodedata.category(t[j - 1])[0] not in "LN":
        j -= 1
    return t[i:j] or None


@F.arrow_udf(T.StringType())
def _canonical_wide(texts: pa.Array) -> pa.Array:
    """canonical_term of the rows that hold a text; each distinct text of a batch is worked out once."""
    d = texts.dictionary_encode()
    words = pa.array([canonical_term(w) for w in d.dictionary.to_pylist()], pa.string())
    return words.take(d.indices)


def term_column(text) -> F.Column:
    """The term of a text column: ASCII rows stay in the JVM, the others go through Arrow."""
    text = F.col(text) if isinstance(text, str) else text
    ascii_only = text.rlike(r"\A[\x00-\x7f]*\z")
    plain = F.nullif(F.lower(F.regexp_replace(text, r"\A[^A-Za-z0-9]+|[^A-Za-z0-9]+\z", "")), F.lit(""))
    return F.when(ascii_only, plain).otherwise(_canonical_wide(F.when(~ascii_only, text)))


def term_frequencies(words: DataFrame, text: str, record: str, key: str, min_records: int = 3, max_share: float = 0.5) -> DataFrame:
    """term, occurrences, records, mark (``rare``, ``common`` or null) of every distinct term of ``words``.

    Rows count once per ``key``: re-delivered rows (same key, record and text) fall together. A null key counts as
    one key per record and text. Rows with a null record count their occurrences but belong to no record.
    Null, empty and sign-only texts have no term, but their records belong to the number of records that
    ``max_share`` refers to. An empty table gives an empty result. Other columns are ignored.

    The distinct and the count both hash on all grouping columns, with map-side combining, so neither a hot record nor a
    hot term meets in one task.
    """
    w = words.select(F.col(key).alias("_k"), F.col(record).alias("_r"), F.col(text).alias("_t"))
    total = words.select(F.col(record).alias("_r")).distinct().agg(F.count("_r")).scalar()
    per_record = (
        w.where(F.col("_t").isNotNull() & (F.col("_t") != ""))
        .distinct()
        .select("_r", term_column("_t").alias("term"))
        .groupBy("term", "_r")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    mark = F.when(F.col("records") < min_records, F.lit("rare")).when(F.col("records") > max_share * total, F.lit("common"))
    # a filter on the term itself would be pushed below the counts, and the terms be worked out once more for it
    counts = per_record.groupBy("term").agg(F.sum("_n").alias("occurrences"), F.count("_r").alias("records"), F.max(F.col("term").isNotNull()).alias("_ok")).where("_ok").drop("_ok")
    return counts.withColumn("mark", mark)


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "harmonized_words"), "text", "file_id", "word_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


QUERIES = {"p1_found": found, "p1_terms": _frequencies}
ORACLE: dict[str, str] = {}

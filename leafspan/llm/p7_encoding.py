"""Problem 7: the ids of every document under a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.tokenizing import ids_of, offsets_of, text_of, token_count, tokenizer_path
from leafspan.sources import table


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, offsets: bool = False) -> DataFrame:
    """``df`` with the ids of its text column in ``out`` (replaced if it is there), without special tokens.

    Empty and null texts get an empty array; a text that spells a special token is encoded as ordinary text; very long
    texts are encoded whole. Row-local: no shuffle, one pass, other columns untouched. With ``offsets`` the
    column holds structs of id, start and end (code points) instead.
    """
    return df.withColumn(out, (offsets_of if offsets else ids_of)(F.col(text), path or tokenizer_path()))


def decode_corpus(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of its ids column; an empty array gives an empty text, null ids give null."""
    return df.withColumn(out, text_of(F.col(ids), path or tokenizer_path()))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by language, and how many documents decode to their own text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    back = decode_corpus(encode_corpus(docs))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("ids").cast("bigint")).alias("tokens"), F.count_if(same).alias("restored"))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text"), tokenizer_path()).alias("n_tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p7_lengths": p7_lengths}
ORACLE: dict[str, str] = {}

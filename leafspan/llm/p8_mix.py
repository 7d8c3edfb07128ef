"""Problem 8: a mix in which every source has its target share of all tokens.

Documents get a hash-random key; within a source they stand in the order of their keys. Bucket sums of token counts and a
prefix over the buckets give every document its distributed prefix sum, and each source is cut at its budget: whole passes
over the source, then the documents up to the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.llm.tokenizing import token_count, tokenizer_path
from leafspan.session import cut
from leafspan.sources import table

#: Ranges of the hash-random key per source; a range is the most that one task has to sort.
BUCKETS = 4096


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", total_tokens: int | None = None, meet: str = "total", seed: int = 17, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """One row per document used: key, source, n_tokens, uses (how often it is to be repeated).

    ``targets`` has source, target_share and max_repeats, one row each. A source's budget is its share of ``total_tokens``
    (all tokens of the sources that have a target, unless given), at most ``max_repeats`` passes over the source. Where sources fall short
    of that, the others keep their budgets and have more than their share of what there is. With ``meet`` "shares" the total is instead the largest
    at which no source that has tokens falls short: their shares, in proportion, are then met exactly. The document
    on which the cut falls is used if that comes nearer to the budget, so a source ends within half a document of it.
    Documents of sources without target, of a null source, and without tokens (null and empty texts) are not used; a
    source with a target but no documents has no row here and share 0 in the report. Equal keys (rows repeated) are told
    apart by nothing and count as documents of their own. Null shares count as 0, null max_repeats as 1.
    """
    t = targets.select(F.col(source).alias("_s"), F.coalesce("target_share", F.lit(0.0)).alias("_share"), F.coalesce("max_repeats", F.lit(1)).cast("bigint").alias("_max")).dropDuplicates(["_s"])
    counted = docs.where(F.col(source).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("_k"), F.col(source).alias("_s"), token_count(F.col(text), path or tokenizer_path()).alias("_n"))
    hashed = F.xxhash64(F.lit(seed), F.col("_k"), F.col("_n"))
    keyed = counted.withColumn("_h", hashed).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(1 << 24)) * buckets / F.lit(1 << 24)).withColumn("_b", F.floor("_b").cast("int"))
    keyed = cut(keyed.join(t.select("_s"), "_s", "left_semi"))

    sums = keyed.groupBy("_s", "_b").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select("_s", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy("_s")).alias("_all"))
    if total_tokens is None:
        total = F.lit(keyed.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"])
    else:
        total = F.lit(total_tokens)
    if meet == "shares":
        # one row per source with a target
        t_met = sums.groupBy("_s").agg(F.sum("_sum").alias("_have")).join(t, "_s").where("_share > 0 and _have > 0")
        row = t_met.agg(F.min(F.col("_have") * F.col("_max") / F.col("_share")).alias("n"), F.sum("_share").alias("s")).first()
        total = F.least(total.cast("double") / F.lit(row["s"] or 1.0), F.lit(row["n"] or 0.0))
    elif meet != "total":
        raise ValueError(f"no such aim: {meet}")
    budget = F.least(F.col("_share") * total, (F.col("_all") * F.col("_max")).cast("double"))
    places = places.join(t, "_s").withColumn("_budget", budget).withColumn("_passes", F.floor(F.col("_budget") / F.col("_all"))).withColumn("_rest", F.col("_budget") - F.col("_passes") * F.col("_all"))

    inside = Window.partitionBy("_s", "_b").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("_to", F.sum("_n").over(inside)).join(places, ["_s", "_b"])
    middle = F.col("_before") + F.col("_to") - F.col("_n") / 2
    uses = F.col("_passes") + F.when(middle <= F.col("_rest"), 1).otherwise(0)
    return placed.select(F.col("_k").alias(key), F.col("_s").alias(source), F.col("_n").alias("n_tokens"), uses.cast("bigint").alias("uses")).where("uses > 0")


def mix_report(mix: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """source, target_share, documents, tokens, most_uses, actual_share (of all tokens of the mix) and short of every target: "no documents", "repeats
    exhausted" where every document is used as often as it may be and the share is not reached, null where it is."""
    used = mix.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.min("uses").alias("_least"))
    all_sources = Window.partitionBy(F.lit(0))
    return (
        targets.select(source, "target_share", F.coalesce("max_repeats", F.lit(1)).alias("_max"))
        .join(used, source, "left")
        .na.fill(0, ["documents", "tokens", "most_uses"])
        .withColumn("_all", F.sum("tokens").over(all_sources))
        .select(source, "target_share", "documents", "tokens", "most_uses", F.coalesce(F.round(F.expr("try_divide(tokens, _all)"), 6), F.lit(0.0)).alias("actual_share"), "_max", "_least")
        .withColumn("short", F.when((F.col("documents") == 0) & (F.col("target_share") > 0), "no documents").when((F.col("_least") >= F.col("_max")) & (F.col("actual_share") < F.col("target_share")), "repeats exhausted"))
        .drop("_max", "_least")
    )


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, table(spark, sf_dir, "mix_targets"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def met_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the largest mix in which no source with documents falls short."""
    docs, targets = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets")
    return mix_report(mix_sources(docs, targets, meet="shares"), targets)


QUERIES = {"p8_mix": _mix, "p8_shares": shares, "p8_met_shares": met_shares}
ORACLE: dict[str, str] = {}

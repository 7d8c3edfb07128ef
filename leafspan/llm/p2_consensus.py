"""Problem 2: one label per item from several annotators who disagree, with agreement and reliabilities.

Triplet moments: with a_i the chance-corrected accuracy of annotator i, annotators that err independently agree in pairs at
the chance-corrected rate a_i * a_j, so three pairwise rates give each accuracy. Votes are combined with log-odds weights. Two further
annotators, whose accuracies are learnt in the same way, speak for what is known beside an item's readings: the lexicon for the reading that is
oftenest read without dispute in the whole table, the form for those that mix least what words don't mix.
"""

from __future__ import annotations

from itertools import combinations
from math import log, sqrt
from statistics import median

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.session import cut
from leafspan.sources import table

#: The annotators that stand for the rest of the table.
EVIDENCE = ("lexicon", "form")
LEAST, MOST = 0.02, 0.995


def _present(c: str) -> F.Column:
    return F.when(F.col(c) != "", F.col(c))


def _core(text: F.Column) -> F.Column:
    """The text as it is counted for the prior: lower case, without signs at its edges."""
    return F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _breaks(text: F.Column) -> F.Column:
    """How often a text mixes what words don't mix: letters with digits, a sign inside letters, capitals behind small
    letters, letters within a number of four digits or more, doubled or odd signs at an edge."""
    inner = F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    mixed = F.regexp_count(inner, F.lit(r"(?<=\p{Ll})[0-9]|(?<=[0-9])\p{Ll}"))
    sign = F.regexp_count(inner, F.lit(r"(?<=\p{L})[^\p{L}\p{N}\s'’.@/&­‐‑-]+(?=\p{L})"))
    capital = F.regexp_count(inner, F.lit(r"(?<=\p{Ll})\p{Lu}"))
    number = F.when(F.regexp_count(inner, F.lit("[0-9]")) >= 4, F.regexp_count(inner, F.lit(r"(?<=[0-9/.-])[A-Za-z](?=[0-9/.-]|$)"))).otherwise(0)
    edge = F.regexp_count(text, F.lit(r"[*~`^_|]|[:.,'][.,;:?!]$|^[.,:*]"))
    return (mixed + sign + capital + number + edge).cast("double")


def accuracies(agreement: dict[tuple[str, str], float], voters: list[str], chance: float) -> dict[str, dict[str, float]]:
    """accuracy and weight of each voter from the rates at which pairs agree, by triplets: of three voters that err independently the chance-corrected
    rates give each one's. The median over a voter's triplets counts; without any its accuracy is 0.7."""
    corrected = {}
    for (a, b), rate in agreement.items():
        corrected[a, b] = corrected[b, a] = max(1e-6, (rate - chance) / (1 - chance))
    out = {}
    for a in voters:
        others = [x for x in voters if x != a]
        moments = [sqrt(corrected[a, b] * corrected[a, c] / corrected[b, c]) for b, c in combinations(others, 2) if (a, b) in corrected and (a, c) in corrected and (b, c) in corrected]
        accuracy = min(MOST, max(LEAST, median(moments) * (1 - chance) + chance)) if moments else 0.7
        # a wrong reading is one of the few confusions of a word, so the odds are those of two equal choices
        out[a] = {"accuracy": accuracy, "weight": log(accuracy / (1 - accuracy))}
    return out


def annotator_reliability(items: DataFrame, annotators: list[str]) -> dict[str, dict[str, float]]:
    """accuracy and weight of each annotator, from one pass of counts; fewer than three annotators, or pairs that never meet,
    leave an accuracy of 0.7.

    Chance agreement is the probability that two readings drawn from the whole table are equal.
    """
    has = {a: F.col(a).isNotNull() for a in annotators}
    pairs = list(combinations(annotators, 2))
    row = items.agg(
        *[F.count_if(has[a] & has[b]).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(F.col(a) == F.col(b)).alias(f"e{i}") for i, (a, b) in enumerate(pairs)],
    ).first()
    labels = items.select(F.explode(F.array_compact(F.array(*annotators))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    spread = labels.agg(F.sum(F.col("n").cast("double")).alias("n"), F.sum(F.pow("n", F.lit(2.0))).alias("nn")).first()
    # a table in which all readings are equal tells nothing
    chance = min(1 - 1e-6, spread["nn"] / spread["n"] ** 2) if spread["n"] else 0.0
    rates = {p: row[f"e{i}"] / row[f"n{i}"] for i, p in enumerate(pairs) if row[f"n{i}"]}
    return accuracies(rates, annotators, chance)


def evidence_reliability(choices: DataFrame, voters: list[str]) -> dict[str, dict[str, float]]:
    """accuracy and weight of EVIDENCE, from the labels of disputed items (a row each, with a Boolean per voter: whether it is for the label) by triplets
    with the annotators. Chance agreement is that of a choice among an item's labels."""
    all_ = [*voters, *EVIDENCE]
    pairs = list(combinations(all_, 2))
    both = choices.groupBy("_key", "_readings").agg(F.count(F.lit(1)).alias("n"), *[F.max(v).alias(v) for v in all_], *[F.max(F.col(a) & F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    row = both.agg(F.avg(1 / F.col("n")).alias("chance"), *[F.count_if(F.col(a) & F.col(b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)], *[F.count_if(f"s{i}").alias(f"e{i}") for i in range(len(pairs))]).first()
    rates = {p: row[f"e{i}"] / row[f"n{i}"] for i, p in enumerate(pairs) if row[f"n{i}"]}
    learnt = accuracies(rates, all_, row["chance"] or 0.0)
    return {e: learnt[e] for e in EVIDENCE}


def _weighed(items: DataFrame, annotators: list[str], also: list[str], evidence: bool, disputed: bool) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """The labels of items (_key, _readings, label, agreement, and a Boolean for each voter), and the reliabilities of the voters."""
    voters = [*annotators, *also]
    learnt = annotator_reliability(items, voters)
    own = F.array_compact(F.array(*annotators))
    labels = F.array_distinct(own)
    wanted = items.where(F.size(labels) > (1 if disputed else 0))
    equal = sum((F.when(F.col(a) == F.col(b), 1).otherwise(0) for a, b in combinations(annotators, 2)), F.lit(0))
    met = F.size(own) * (F.size(own) - 1) / 2
    for_ = [F.coalesce(F.col(a) == F.col("_label"), F.lit(False)).alias(f"_v{i}") for i, a in enumerate(voters)]
    choices = wanted.withColumn("_agreement", F.when(met > 0, equal / met).otherwise(1.0)).withColumn("_label", F.explode(labels)).select("_key", F.xxhash64(*voters).alias("_readings"), F.col("_agreement").alias("agreement"), F.col("_label").alias("label"), *for_)
    if not evidence:
        return choices, learnt
    undisputed = items.where((F.size(labels) == 1) & (F.size(own) > 1)).groupBy(_core(F.get(labels, F.lit(0))).alias("core")).agg(F.count(F.lit(1)).alias("known"))
    item = Window.partitionBy("_key", "_readings")
    known = F.coalesce("known", F.lit(0))
    told = choices.withColumn("core", _core(F.col("label"))).withColumn("breaks", _breaks(F.col("label"))).join(undisputed, "core", "left").withColumn("known", known)
    least, most = F.min("breaks").over(item), F.max("breaks").over(item)
    told = told.withColumn("lexicon", (F.col("known") > 0) & (F.col("known") == F.max("known").over(item))).withColumn("form", (F.col("breaks") == least) & (most > least))
    told = cut(told.drop("core", "known", "breaks"))
    return told, learnt | evidence_reliability(told, [f"_v{i}" for i in range(len(voters))])


def _items(items: DataFrame, key: str, voters: list[str]) -> DataFrame:
    return cut(items.select(F.col(key).alias("_key"), *[_present(a).alias(a) for a in voters]).distinct())


def consensus(items: DataFrame, key: str, annotators: list[str], also: list[str] = [], evidence: bool = True, disputed: bool = True) -> DataFrame:
    """key, label, agreement, confidence of every item.

    A reading that is null or "" is absent. ``also`` names further annotators, whose readings vote for labels that one
    of ``annotators`` has read. With ``evidence`` the lexicon and the form vote too. agreement is the share of pairs of present annotators that agree;
    confidence is the label's posterior among the item's readings. With ``disputed`` only items with two or more different readings are given; items
    without readings have no row, items with one reading agree fully. Repeated rows of a key with the same readings count once; a null
    key is an item for each set of readings. Ties go to the reading that sorts first. An empty table gives an empty result.
    """
    voters = [*annotators, *also]
    choices, learnt = _weighed(_items(items, key, voters), annotators, also, evidence, disputed)
    column = {a: f"_v{i}" for i, a in enumerate(voters)}
    score = sum((F.when(F.col(column.get(v, v)), r["weight"]).otherwise(0.0) for v, r in learnt.items()), F.lit(0.0))
    # the scores of an item's few labels come together; negated labels make the first in order win ties
    item = choices.withColumn("score", score).groupBy("_key", "_readings").agg(F.first("agreement").alias("agreement"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("loss"), "label"))).alias("ranked"))
    best = F.get("ranked", F.lit(0))
    share = F.aggregate("ranked", F.lit(0.0), lambda s, x: s + F.exp(best["loss"] - x["loss"]))
    return item.select(F.col("_key").alias(key), best["label"].alias("label"), F.round("agreement", 6).alias("agreement"), F.round(1 / share, 6).alias("confidence"))


ENGINES = ["tess_text", "easy_text", "doctr_text", "surya_text"]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "harmonized_words").select("word_id", *ENGINES, "paddle_text")


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(_words(spark, sf_dir), "word_id", ENGINES, ["paddle_text"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).select("word_id", "label")


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and weight of every voter as p2_found uses them: of the engines over all words, of the lexicon and the form over disputed ones."""
    also = ["paddle_text"]
    _, learnt = _weighed(_items(_words(spark, sf_dir), "word_id", [*ENGINES, *also]), ENGINES, also, True, True)
    return spark.createDataFrame([(a, round(r["accuracy"], 6), round(r["weight"], 6)) for a, r in learnt.items()], "engine string, accuracy double, weight double")


QUERIES = {"p2_found": found, "p2_consensus": _consensus, "p2_reliability": reliability}
ORACLE: dict[str, str] = {}

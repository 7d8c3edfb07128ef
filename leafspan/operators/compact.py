"""The compact preset: two engines, a plain vote, greedy de-duplication, lines by bands, look-up by first letter, and what a viewer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import geometry as G
from leafspan.operators.matching import BOX, PAGE, banded_pairs, duplicates
from leafspan.operators.sanitize import Config, _rank_of, similar_pairs

#: What agreement adds to the confidences of a text, and the confidence from which a word is sure.
AGREED, SURE = 50.0, 80.0
#: Names of the source letters.
SOURCES = {"T": "Tesseract", "E": "EasyOCR", "D": "docTR", "P": "PaddleOCR", "S": "Surya", "K": "Kraken", "PX": "Pixel Detection", "X": "Pixel Detection"}


def best_text(ballots: DataFrame, key: str = "primary_id") -> DataFrame:
    """``key``, text, confidence, low_confidence, reason: the text, without regard to case, with the greatest sum of confidences, AGREED more where several
    engines have it; of its spellings the surest. Equal sums go to the text of the first engine (``ord``). ``ballots`` has key, ord, engine, text,
    confidence; low_confidence is whether no vote is SURE."""
    one = ballots.groupBy(key, F.lower(F.trim("text")).alias("norm")).agg(F.sum("confidence").alias("sum"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.min(F.struct((-F.col("confidence")).alias("c"), "ord", "text", "engine")).alias("top"))
    score = F.col("sum") + F.when(F.col("n") > 1, AGREED).otherwise(0.0)
    all_ = one.groupBy(key).agg(F.min(F.struct((-F.round(score, 6)).alias("s"), "ord", F.col("top.text").alias("text"), "n", F.col("top.engine").alias("engine"))).alias("best"), F.max(-F.col("top.c")).alias("confidence"), F.sum("n").alias("votes"))
    reason = F.when(F.col("votes") == 1, F.concat(F.lit("only "), "best.engine")).when(F.col("best.n") > 1, "agreement").otherwise(F.concat(F.lit("surer: "), "best.engine"))
    return all_.select(key, "best.text", "confidence", (F.col("confidence") < SURE).alias("low_confidence"), reason.alias("reason"))


def deduplicated(words: DataFrame, order: str = "word_id") -> DataFrame:
    """The words of which, in order, none kept before is a duplicate: a fold over the few words of a page that have duplicates at all."""
    w = words.select(*PAGE, "word_id", order, "text", *BOX) if order != "word_id" else words.select(*PAGE, "word_id", "text", *BOX)
    pairs = banded_pairs(w, w, 20.0).where((F.col(f"l_{order}") < F.col(f"r_{order}")) & duplicates())
    pairs = pairs.select(F.col("l_file_id").alias("file_id"), F.col("l_page").alias("page"), F.struct(F.col(f"r_{order}").alias("o"), F.col("r_word_id").alias("r"), F.col("l_word_id").alias("l")).alias("p"))
    gone = F.aggregate(F.array_sort(F.collect_list("p")), F.array().cast("array<bigint>"), lambda s, x: F.when(F.array_contains(s, x["l"]) | F.array_contains(s, x["r"]), s).otherwise(F.array_append(s, x["r"])))
    dropped = pairs.groupBy(*PAGE).agg(gone.alias("gone")).select(*PAGE, F.explode("gone").alias("word_id"))
    return words.join(dropped, [*PAGE, "word_id"], "left_anti")


def lines_by_band(order: DataFrame) -> DataFrame:
    """``order`` (position, band) with line: a new one begins where the band changes along the reading order."""
    w = Window.partitionBy(*PAGE).orderBy("position")
    new = F.when(F.col("band") != F.lag("band").over(w), 1).otherwise(0)
    return order.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def lines_by_height(words: DataFrame, fuzz: float = 10.0, order: str = "word_id") -> DataFrame:
    """file_id, page, word_id, line: a new line begins where a center is more than twice the fuzz from the line's, which moves half the way to each word."""
    item = F.struct(F.col(order).alias("o"), "word_id", G.center_y().alias("cy"))
    state = "struct<line:bigint,at:double,out:array<struct<word_id:bigint,line:bigint>>>"
    start = F.struct(F.lit(-1).cast("bigint").alias("line"), F.lit(None).cast("double").alias("at"), F.array().cast("array<struct<word_id:bigint,line:bigint>>").alias("out")).cast(state)

    def add(s: Column, x: Column) -> Column:
        new = s["at"].isNull() | (F.abs(x["cy"] - s["at"]) > 2 * fuzz)
        line = s["line"] + F.when(new, 1).otherwise(0)
        at = F.when(new, x["cy"]).otherwise((s["at"] + x["cy"]) / 2)
        return F.struct(line.cast("bigint").alias("line"), at.alias("at"), F.array_append(s["out"], F.struct(x["word_id"].alias("word_id"), line.cast("bigint").alias("line"))).alias("out"))

    page = words.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, add)["out"].alias("l"))
    return page.select(*PAGE, F.explode("l").alias("x")).select(*PAGE, "x.word_id", "x.line")


def tolerant_order(words: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """``words`` with position on their page: by steps of ``tolerance`` from the top of the page, in a step from left to right. A comparison of pairs
    within a tolerance is no order; steps are."""
    w = Window.partitionBy(*PAGE).orderBy(F.floor(F.col("y0") / tolerance), "x0", "word_id")
    return words.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def first_letter_pairs(queries: DataFrame, terms: DataFrame, k: int, config: Config = Config()) -> DataFrame:
    """query, term, dictionary, distance, score: terms within ``k`` edits that begin with the query's first letter, or, where there are none, with its second letter
    or a neighbour of its first in the alphabet. Of an entry with distance 0 only the first is given, in the order of the dictionaries. This preset misses what
    begins otherwise, by design; ``similar_pairs`` does not."""
    pairs = similar_pairs(queries, terms, k, "query", "term_lower").join(terms.select("term_lower", "term", "dictionary", "weight", _rank_of(F.col("dictionary"), config).alias("rank")), "term_lower")
    first, second = F.substr("query", F.lit(1), F.lit(1)), F.substr("query", F.lit(2), F.lit(1))
    head, code = F.substr("term_lower", F.lit(1), F.lit(1)), F.ascii(F.substr("query", F.lit(1), F.lit(1)))
    near = ((head == second) & (F.length("query") > 1)) | ((F.ascii(head) == code - 1) & (code > 97)) | ((F.ascii(head) == code + 1) & (code < 122))
    pairs = pairs.withColumn("step", F.when(head == first, 1).when(near, 2)).where("step is not null")
    q = Window.partitionBy("query")
    pairs = pairs.withColumn("_least", F.min("step").over(q)).where("step = _least")
    exact = F.min(F.when(F.col("distance") == 0, F.struct("rank", "term"))).over(q)
    pairs = pairs.withColumn("_exact", exact).where(F.col("_exact").isNull() | (F.struct("rank", "term") <= F.col("_exact")) & ((F.col("distance") > 0) | (F.struct("rank", "term") == F.col("_exact"))))
    return pairs.select("query", "term", "dictionary", "distance", F.round(F.col("weight") * (1 - F.col("distance") / (k + 1)), 9).alias("score"))


def shown(engines: Column, visible: list[str], status: Column | None = None, entity: Column | None = None, sanitized: bool = False, harmonized: bool = False, entities: bool = False) -> Column:
    """Whether a viewer shows a word: one of its engines is visible, or it is highlighted (corrected or uncertain, read by several engines, an entity)."""
    out = F.arrays_overlap(engines, F.array(*[F.lit(v) for v in visible]))
    if sanitized and status is not None:
        out = out | F.coalesce(status.isin("corrected", "context", "uncertain"), F.lit(False))
    if harmonized:
        out = out | (F.size(engines) > 1)
    if entities and entity is not None:
        out = out | (F.coalesce(entity, F.lit("")) != "")
    return out


def source_names(source: Column) -> Column:
    """The engines that source letters stand for, joined by " + "; a letter without a name stands for itself, no letters give "-"."""
    names = F.create_map(*[F.lit(x) for k, v in SOURCES.items() for x in (k, v)])
    each = F.transform(F.split(source, ""), lambda c: F.coalesce(names[c], c))
    return F.when(F.coalesce(source, F.lit("")) == "", "-").when(source.isin("PX", "X"), names[source]).otherwise(F.array_join(each, " + "))


def escaped(text: Column) -> Column:
    """A text as it stands in HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text

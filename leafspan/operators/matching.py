"""Spatial matching of words: candidate pairs from equi-joins on page and band, and greedy assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.functions import geometry as G
from leafspan.functions.text import similarity
from leafspan.session import spread

PAGE = ["file_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]


@dataclass(frozen=True)
class WordMatch:
    """Thresholds of a word-level match; ``rescue`` allows a sure secondary word to match an unsure primary one by containment."""

    iou: float = 0.3
    text_bonus: float = 0.15
    center_distance: float = 12.0
    rescue: bool = True

    @property
    def band(self) -> float:
        """How far apart vertically the centers of words that may match are."""
        return max(10.0, self.center_distance / 2)


#: Height of a band of a page, in points, where nothing asks for a higher one.
BAND = 20.0


def span(reach: float | Column = 0.0, p: str = "") -> tuple[Column, Column]:
    """The vertical extent of a box, and at least ``reach`` above and below its center."""
    y0, y1, mid = F.col(f"{p}y0"), F.col(f"{p}y1"), G.center_y(p)
    return F.least(y0, y1, mid - reach), F.greatest(y0, y1, mid + reach)


def banded_pairs(left: DataFrame, right: DataFrame, reach: float = 0.0, keys: list[str] = PAGE, spans: tuple[tuple[Column, Column], tuple[Column, Column]] | None = None, band: Column | float = BAND) -> DataFrame:
    """Pairs of a left and a right word of one page whose vertical extents meet, whatever their heights: those of their boxes, the right one
    reaching at least ``reach`` from its center; or ``spans``, (top, bottom) of the left and of the right side as expressions of their columns.

    Columns are prefixed l_ and r_. Both sides stand in every band that they touch, so the join has equalities on page and band; a pair counts
    in the first band that both touch, and so appears once. ``band`` is a number, or an expression that is the same for all words of a page: where
    words reach far, high bands keep the copies few.
    """
    (l_top, l_end), (r_top, r_end) = spans or (span(), span(reach))
    place = lambda y: F.floor(y / band)

    def in_bands(rows: DataFrame, top: Column, end: Column, p: str) -> DataFrame:
        first = rows.select(*[F.col(c).alias(f"{p}{c}") for c in rows.columns], place(top).alias(f"_{p}first"), place(end).alias(f"_{p}last"))
        bands = F.when(F.col(f"_{p}last") >= F.col(f"_{p}first"), F.sequence(f"_{p}first", f"_{p}last"))
        return first.select("*", F.explode(bands).alias(f"_{p}band")).drop(f"_{p}last")

    l, r = in_bands(left, l_top, l_end, "l_"), in_bands(right, r_top, r_end, "r_")
    l, r = (spread(side, *[f"{p}{k}" for k in keys], f"_{p}band") for side, p in ((l, "l_"), (r, "r_")))
    on = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys] + [F.col("_l_band") == F.col("_r_band"), F.col("_l_band") == F.greatest("_l_first", "_r_first")]
    return l.join(r, on).drop("_l_band", "_r_band", "_l_first", "_r_first")


def match_score(m: WordMatch, iou: Column | None = None, distance: Column | None = None) -> Column:
    """Score of a candidate pair (l_ primary, r_ secondary), null where it is no match; ``iou`` and ``distance`` instead of the fixed thresholds."""
    iou = F.lit(m.iou) if iou is None else iou
    distance = F.lit(m.center_distance) if distance is None else distance
    overlap = G.iou("l_", "r_")
    same = F.lower(F.trim("l_text")) == F.lower(F.trim("r_text"))
    close = same & (G.center_distance("l_", "r_") <= distance) & (distance > 0)
    unsure = (F.col("r_confidence") >= 90) & (F.col("l_confidence") <= 30)
    inside = G.contains("l_", G.center_x("r_"), G.center_y("r_")) | G.contains("r_", G.center_x("l_"), G.center_y("l_"))
    rescued = unsure & inside & F.lit(m.rescue)
    hit = (overlap >= F.when(same, iou - m.text_bonus).otherwise(iou)) | close | rescued
    score = overlap + F.when(same, 0.5).otherwise(0.0) + (F.when(unsure & inside, 0.3).otherwise(0.0) if m.rescue else F.lit(0.0))
    return F.when(hit & (score > 0), score)


def greedy_assign(pairs: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """Left items in order each take their best right item that is still free; equal scores go to the first right item.

    A group's candidates are sorted by (left, score descending, right) and folded once, without leaving the JVM. Groups are pages, or a page's
    rows of one source: their size has nothing to do with the table's.
    """
    item = F.struct(F.col(left).alias("l"), (-F.col(score)).alias("s"), F.col(right).alias("r"))
    empty = F.struct(F.array().cast("array<bigint>").alias("ls"), F.array().cast("array<bigint>").alias("rs"), F.array().cast("array<struct<l:bigint,r:bigint,score:double>>").alias("out"))

    def take(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["ls"], x["l"]) & ~F.array_contains(s["rs"], x["r"])
        taken = F.struct(F.array_append(s["ls"], x["l"]).alias("ls"), F.array_append(s["rs"], x["r"]).alias("rs"), F.array_append(s["out"], F.struct(x["l"].alias("l"), x["r"].alias("r"), (-x["s"]).alias("score"))).alias("out"))
        return F.when(free, taken).otherwise(s)

    folded = pairs.groupBy(*group).agg(F.aggregate(F.array_sort(F.collect_list(item)), empty, take)["out"].alias("_m"))
    return folded.select(*group, F.explode("_m").alias("_x")).select(*group, F.col("_x.l").alias(left), F.col("_x.r").alias(right), F.col("_x.score").alias(score))


def match_to_truth(found: DataFrame, truth: DataFrame, threshold: float = 0.5, key: str = "word_id", by: list[str] = []) -> DataFrame:
    """found_id, truth_id, iou: found words in order each take the free true word of their page with the greatest IoU of at least ``threshold``. With
    ``by``, columns of ``found``, the words of each of its values are matched on their own, and these columns are given too."""
    p = banded_pairs(found, truth).withColumn("iou", G.iou("l_", "r_")).where((F.col("iou") >= threshold) & (F.col("iou") > 0))
    p = p.select(F.col("l_file_id").alias("file_id"), F.col("l_page").alias("page"), *[F.col(f"l_{c}").alias(c) for c in by], F.col(f"l_{key}").alias("found_id"), F.col(f"r_{key}").alias("truth_id"), "iou")
    return greedy_assign(p, [*PAGE, *by], "found_id", "truth_id", "iou")


def evaluation(found: DataFrame, truth: DataFrame, matches: DataFrame, key: str = "word_id", by: list[str] = [], pass_mark: float | None = None) -> DataFrame:
    """One row, or one for each value of ``by``: true positives, false positives, false negatives, precision, recall, f1, mean_iou, text_ratio (0 where nothing
    is there); with ``pass_mark`` also passed, whether f1 reaches it."""
    f = found.select(F.col(key).alias("found_id"), F.col("text").alias("f_text"))
    t = truth.select(F.col(key).alias("truth_id"), F.col("text").alias("t_text"))
    hits = matches.join(f, "found_id").join(t, "truth_id").groupBy(*by).agg(
        F.count(F.lit(1)).alias("tp"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.count_if(F.lower(F.trim("f_text")) == F.lower(F.trim("t_text"))).alias("same")
    )
    n_truth = truth.agg(F.count(F.lit(1)).alias("n_truth")).scalar()
    n = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_found"))
    hits = n.join(hits, by, "left").na.fill(0) if by else hits.withColumn("n_found", n.scalar())
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    r = hits.withColumn("fp", F.col("n_found") - F.col("tp")).withColumn("fn", n_truth - F.col("tp"))
    r = r.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    r = r.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    passed = [] if pass_mark is None else [(F.col("f1") >= pass_mark).alias("passed")]
    return r.select(*by, "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou")], F.round(ratio(F.col("same"), F.col("tp")), 6).alias("text_ratio"), *passed)


def duplicates(a: str = "l_", b: str = "r_") -> Column:
    """Whether two words are one: IoU of a half, or the same text with centers less than 20 points apart."""
    same = F.lower(F.trim(f"{a}text")) == F.lower(F.trim(f"{b}text"))
    return (G.iou(a, b) >= 0.5) | (same & (G.center_distance(a, b) < 20))


def acceptable(a: str = "l_", b: str = "r_") -> Column:
    """Whether a found word may stand for a true one: IoU of 0.3 and texts that are equal, contain each other or are 0.7 similar."""
    x, y = F.col(f"{a}norm"), F.col(f"{b}norm")
    return (G.iou(a, b) >= 0.3) & ((x == y) | x.contains(y) | y.contains(x) | (similarity(x, y) >= 0.7))

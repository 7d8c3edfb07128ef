"""Quality filters on words (triage) and on candidate regions of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import geometry as G
from leafspan.functions.text import punctuation_only
from leafspan.session import cut


@dataclass(frozen=True)
class Triage:
    """What a word must have to pass."""

    min_confidence: float
    max_aspect: float
    min_area: float
    punctuation_confidence: float | None = None
    both_engines_excuse: bool = False
    min_length: int = 1


#: Fixed values of the three levels.
LEVELS = {
    "strict": Triage(40.0, 30.0, 10.0, 60.0, True),
    "normal": Triage(20.0, 40.0, 6.0, 40.0),
    "permissive": Triage(0.0, 100.0, 2.0),
}


def passes(level: Triage, text: str = "text", confidence: str = "conf", pixel: Column | None = None, both: Column | None = None) -> Column:
    """Whether a word passes: pixel rows always do; a low confidence is excused, in the strict level, where both engines gave one."""
    t, c = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(confidence), F.lit(0.0))
    ok = F.length(F.trim(t)) >= level.min_length
    sure = c >= level.min_confidence
    ok = ok & ((sure | both) if level.both_engines_excuse and both is not None else sure)
    ok = ok & ((G.height() <= 0) | (F.try_divide(G.width(), G.height()) <= level.max_aspect)) & (G.area() >= level.min_area)
    if level.punctuation_confidence is not None:
        ok = ok & ~(punctuation_only(t) & (c < level.punctuation_confidence))
    return ok if pixel is None else pixel | ok


def triage(words: DataFrame, level: str, **columns) -> DataFrame:
    return words.where(passes(LEVELS[level], **columns))


def triage_stats(words: DataFrame, level: str, **columns) -> DataFrame:
    """One row: words, kept, removed, and of the removed how many had low confidence, punctuation only, or a tiny box (a word can be in several)."""
    w = words.withColumn("_ok", F.coalesce(passes(LEVELS[level], **columns), F.lit(False)))
    gone = lambda c: F.count_if(~F.col("_ok") & c)
    t, conf = F.coalesce("text", F.lit("")), F.coalesce("conf", F.lit(0.0))
    return w.agg(F.count(F.lit(1)).alias("words"), F.count_if("_ok").alias("kept"), gone(F.lit(True)).alias("removed"), gone(conf < 30).alias("low_confidence"), gone(punctuation_only(t)).alias("punctuation"), gone(G.area() < 10).alias("tiny"))


def region_kind() -> Column:
    """horizontal, vertical, logo, text or null by the size and shape of a candidate region, in this order of precedence."""
    w, h = G.width(), G.height()
    long, tall = F.try_divide(w, h), F.try_divide(h, w)
    widest = F.greatest(long, tall)
    return (
        F.when((w >= 100) & (h <= 10) & (long >= 10), "horizontal")
        .when((h >= 50) & (w <= 10) & (tall >= 5), "vertical")
        .when((G.area() >= 1000) & ~((w < 30) & (h < 30)) & (widest <= 20), "logo")
        .when((G.area() >= 50) & (w >= 10) & h.between(5, 50) & (long <= 50), "text")
    )


def overlaps_any(regions: DataFrame, existing: DataFrame, page: list[str], key: str, bucket: float = 50.0, most: float = 0.1) -> DataFrame:
    """The regions that overlap no existing box of their page: no IoU above ``most``, no center inside one.

    Both sides are spread over the cells of a grid they touch, so the anti-join has an equality on page and cell.
    """
    cells = lambda p: F.explode(
        F.flatten(F.transform(F.sequence(F.floor(F.col(f"{p}x0") / bucket), F.floor(F.greatest(f"{p}x0", f"{p}x1") / bucket)), lambda x: F.transform(F.sequence(F.floor(F.col(f"{p}y0") / bucket), F.floor(F.greatest(f"{p}y0", f"{p}y1") / bucket)), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    )
    box = ["x0", "y0", "x1", "y1"]
    r = regions.select(*page, key, *[F.col(b).alias(f"r_{b}") for b in box]).select("*", cells("r_").alias("cell"))
    e = existing.select(*[F.col(c).alias(f"e_{c}") for c in page], *[F.col(b).alias(f"e_{b}") for b in box]).select("*", cells("e_").alias("e_cell"))
    on = [F.col(c) == F.col(f"e_{c}") for c in page] + [F.col("cell") == F.col("e_cell"), (G.iou("r_", "e_") > most) | G.contains("e_", G.center_x("r_"), G.center_y("r_"))]
    blocked = r.join(e, on, "left_semi").select(*page, key).distinct()
    return regions.join(blocked, [*page, key], "left_anti")


#: Kinds in the order in which they are looked for; text only where the compact preset asks for it.
PASSES = ("horizontal", "vertical", "logo")


def missed_content(regions: DataFrame, existing: DataFrame, page: list[str], key: str, passes: tuple[str, ...] = PASSES, block_own: bool = False) -> DataFrame:
    """``regions`` that show content the words miss, with kind: pass by pass, those of a kind that overlap neither existing boxes nor what an earlier pass found.

    With ``block_own`` a region is also blocked by an earlier one (by ``key``) of its own pass: a fold over the few of a page that overlap at all.
    """
    box = ["x0", "y0", "x1", "y1"]
    kinds = regions.withColumn("kind", region_kind())
    found = None
    blocked = existing.select(*page, *box)
    for kind in passes:
        got = overlaps_any(kinds.where(F.col("kind") == kind), blocked, page, key)
        got = cut(_first_come(got, page, key) if block_own else got)  # later passes read it
        blocked = blocked.unionByName(got.select(*page, *box))
        found = got if found is None else found.unionByName(got)
    return found


def _first_come(regions: DataFrame, page: list[str], key: str, most: float = 0.1) -> DataFrame:
    """The regions of which, in the order of ``key``, no kept one before overlaps."""
    box = ["x0", "y0", "x1", "y1"]
    side = lambda p: regions.select(*[F.col(c).alias(f"{p}{c}") for c in (*page, key, *box)])
    bands = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}y0") / 50), F.floor(F.greatest(f"{p}y0", f"{p}y1") / 50))).alias(f"_{p}band")
    l, r = (side(p).select("*", bands(p)) for p in ("l_", "r_"))
    hit = (G.iou("l_", "r_") > most) | G.contains("l_", G.center_x("r_"), G.center_y("r_"))
    pairs = l.join(r, [F.col(f"l_{c}") == F.col(f"r_{c}") for c in page] + [F.col("_l_band") == F.col("_r_band"), F.col(f"l_{key}") < F.col(f"r_{key}"), hit])
    pairs = pairs.select(*[F.col(f"l_{c}").alias(c) for c in page], F.struct(F.col(f"r_{key}").alias("r"), F.col(f"l_{key}").alias("l")).alias("p")).distinct()
    gone = F.aggregate(F.array_sort(F.collect_list("p")), F.array().cast("array<bigint>"), lambda s, x: F.when(F.array_contains(s, x["l"]) | F.array_contains(s, x["r"]), s).otherwise(F.array_append(s, x["r"])))
    return regions.join(pairs.groupBy(*page).agg(gone.alias("g")).select(*page, F.explode("g").alias(key)), [*page, key], "left_anti")


# -- pictures as rows ------------------------------------------------------------------------------------------------


def raster_statistics(pixels: DataFrame, by: list[str]) -> DataFrame:
    """``by``, sharpness, contrast of pictures given as rows (row, col, value): variance of the Laplacian and deviation of the values, the border mirrored."""
    across, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")

    def around(w) -> Column:
        before, behind = F.lag("value").over(w), F.lead("value").over(w)
        return F.coalesce(before, behind, F.col("value")) + F.coalesce(behind, before, F.col("value"))

    p = pixels.withColumn("_x", around(across)).withColumn("_y", around(down)).withColumn("_l", F.col("_x") + F.col("_y") - 4 * F.col("value"))
    return p.groupBy(*by).agg(F.var_pop("_l").alias("sharpness"), F.stddev_pop("value").alias("contrast"))


def preparation_level(sharpness: Column, contrast: Column) -> Column:
    """How strongly a picture has to be prepared, by its sharpness and contrast."""
    return F.when((sharpness > 500) & (contrast > 50), "light").when((sharpness > 100) & (contrast > 30), "standard").when(sharpness > 50, "aggressive").otherwise("degraded")


def best_orientation(readings: DataFrame, by: list[str], angles: tuple[int, ...] = (0, 90, 180, 270)) -> DataFrame:
    """``by``, angle: of the angles at which a page was read (angle, confidence per word), the one with the greatest mean confidence, then with more words, then
    the first; 0 where no confidence is above 0."""
    one = readings.where(F.col("angle").isin(list(angles))).groupBy(*by, "angle").agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(a) for a in angles]), F.col("angle").cast("int"))
    best = F.max(F.struct(F.round("c", 9).alias("c"), "n", (-rank).alias("o"), "angle"))
    return one.groupBy(*by).agg(best.alias("b")).select(*by, F.when(F.col("b.c") > 0, F.col("b.angle")).otherwise(0).cast("bigint").alias("angle"))

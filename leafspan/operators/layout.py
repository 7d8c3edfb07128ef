"""Layout of a page: distance thresholds, columns, clusters of words, reading order and lines."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspan.functions import geometry as G
from leafspan.operators.matching import BAND, BOX, PAGE, banded_pairs
from leafspan.session import cut, spread


@dataclass(frozen=True)
class Config:
    default_x: float = 50.0
    default_y: float = 20.0
    q1_times: float = 1.5
    floor_x: float = 5.0
    floor_y: float = 3.0
    fuzz_default: float = 5.0
    fuzz_times: float = 2.0
    fuzz_height: float = 0.25
    x_overlap: float = 0.3
    y_overlap: float = 0.5
    vertical_times: float = 3.0
    same_row_times: float = 8.0
    outlier_times: float = 1.2


#: Fixed values of the second preset.
COMPACT = Config(default_x=20.0, default_y=10.0, fuzz_height=0.5, vertical_times=2.0, same_row_times=3.0, outlier_times=3.0)


def _centers(words: DataFrame) -> DataFrame:
    return words.withColumn("cx", G.center_x()).withColumn("cy", G.center_y())


def distance_thresholds(words: DataFrame, config: Config = Config()) -> DataFrame:
    """file_id, page, x_threshold, y_threshold: a multiple of the first quartile of the positive gaps between neighbours in (y, x) order."""
    w = Window.partitionBy(*PAGE).orderBy("cy", "cx", "word_id")
    g = _centers(words).withColumn("gx", F.lead("x0").over(w) - F.col("x1")).withColumn("gy", F.lead("y0").over(w) - F.col("y1"))
    q = g.groupBy(*PAGE).agg(*[F.percentile(F.when(F.col(c) > 0, F.col(c)), 0.25).alias(f"q{c}") for c in ("gx", "gy")])
    t = lambda c, least, default: F.coalesce(F.greatest(F.col(c) * config.q1_times, F.lit(least)), F.lit(default))
    # greatest() skips nulls, so a page without gaps is told by the quartile itself
    pick = lambda c, least, default: F.when(F.col(c).isNull(), default).otherwise(t(c, least, default))
    return q.select(*PAGE, pick("qgx", config.floor_x, config.default_x).alias("x_threshold"), pick("qgy", config.floor_y, config.default_y).alias("y_threshold"))


def row_pairs(words: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pairs of words of a page whose gaps say that they stand in one row, with the distance of their centers."""
    w = words.select(*PAGE, "word_id", *BOX).join(thresholds.select(*PAGE, "x_threshold"), PAGE)
    # a gap of half the smaller height is at most a quarter of either
    tall = F.greatest(G.height(), F.lit(0.0)) / 4
    wide = F.least("y0", "y1") - tall, F.greatest("y0", "y1") + tall
    p = banded_pairs(w, w.drop("x_threshold"), spans=(wide, wide)).where(F.col("l_word_id") < F.col("r_word_id"))
    small = F.least(G.height("l_"), G.height("r_"))
    return p.where((G.gap("l_", "r_", "x") <= 3 * F.col("l_x_threshold")) & (G.gap("l_", "r_", "y") <= 0.5 * small)).select(F.col("l_file_id").alias("file_id"), F.col("l_page").alias("page"), F.abs(G.center_y("l_") - G.center_y("r_")).alias("dy"))


def y_fuzz(words: DataFrame, config: Config = Config(), thresholds: DataFrame | None = None) -> DataFrame:
    """file_id, page, fuzz: how far words of one row are apart vertically, held to a share of the mean height."""
    noise = row_pairs(words, distance_thresholds(words, config) if thresholds is None else thresholds).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.median("dy").alias("med"), F.stddev_pop("dy").alias("std"))
    tall = words.groupBy(*PAGE).agg(F.avg(G.height()).alias("tall"))
    raw = F.when(F.coalesce("n", F.lit(0)) < 3, config.fuzz_default).otherwise(F.greatest(F.col("med") + F.col("std"), config.fuzz_times * F.col("std"), F.lit(config.fuzz_default)))
    return tall.join(noise, PAGE, "left").select(*PAGE, F.least(raw, config.fuzz_height * F.col("tall")).alias("fuzz"))


def rows(words: DataFrame, fuzz: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """``words`` with row: a new one begins where the center lies more than the fuzz below the last."""
    w = Window.partitionBy(*by).orderBy("cy", "word_id")
    new = F.when(F.col("cy") > F.lag("cy").over(w) + F.col("fuzz"), 1).otherwise(0)
    return _centers(words).join(fuzz, PAGE).withColumn("_new", new).withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def column_boundaries(words: DataFrame, config: Config = Config(), fuzz: DataFrame | None = None) -> DataFrame:
    """file_id, page, bounds: the middles of gaps within rows of three times their median or more, sorted, each once."""
    r = rows(words, y_fuzz(words, config) if fuzz is None else fuzz)
    w = Window.partitionBy(*PAGE, "row").orderBy("x0", "word_id")
    g = r.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).withColumn("at", (F.col("x0") + F.lag("x1").over(w)) / 2).where("gap > 0")
    big = g.withColumn("m", F.median("gap").over(Window.partitionBy(*PAGE))).where("gap >= 3 * m")
    found = big.groupBy(*PAGE).agg(F.sort_array(F.collect_set("at")).alias("bounds"))
    return words.select(*PAGE).distinct().join(found, PAGE, "left").withColumn("bounds", F.coalesce("bounds", F.array().cast("array<double>")))


def page_measures(words: DataFrame, config: Config = Config()) -> DataFrame:
    """file_id, page, x_threshold, y_threshold, fuzz, bounds: what the layout of a page is told by, worked out once and written as one row a page."""
    thresholds = cut(distance_thresholds(words, config))
    fuzz = cut(y_fuzz(words, config, thresholds))
    return cut(thresholds.join(fuzz, PAGE).join(column_boundaries(words, config, fuzz), PAGE))


def with_columns_of(words: DataFrame, bounds: DataFrame) -> DataFrame:
    """``words`` with col: how many boundaries lie at or left of the center."""
    return _centers(words).join(bounds, PAGE).withColumn("col", F.size(F.filter("bounds", lambda b: b <= F.col("cx"))).cast("bigint")).drop("bounds")


def cluster_edges(words: DataFrame, config: Config = Config(), measures: DataFrame | None = None) -> DataFrame:
    """file_id, page, a, b, rule of the pairs that belong together: side by side in a row (1), stacked in a column (2), or simply close (3)."""
    m = page_measures(words, config) if measures is None else measures
    w = with_columns_of(words, m).select(*PAGE, "word_id", *BOX, "col", "x_threshold", "y_threshold")
    # no rule reaches farther than the larger of these gaps; each side reaches half of it
    far = F.greatest(F.lit(config.vertical_times), F.lit(1.0)) * F.col("y_threshold")
    wide = F.least("y0", "y1") - far / 2, F.greatest("y0", "y1") + far / 2
    p = banded_pairs(w, w, spans=(wide, wide), band=F.greatest(F.lit(BAND), far)).where(F.col("l_word_id") < F.col("r_word_id")).drop("r_x_threshold", "r_y_threshold")
    p = p.withColumnsRenamed({"l_x_threshold": "x_threshold", "l_y_threshold": "y_threshold"})
    gx, gy = G.gap("l_", "r_", "x"), G.gap("l_", "r_", "y")
    same = F.col("l_col") == F.col("r_col")
    row = (G.overlap_ratio("l_", "r_", "y") >= config.y_overlap) & (gx <= config.same_row_times * F.col("x_threshold"))
    rule = F.when(row, F.when(same | (gx <= 2 * F.col("x_threshold")), 1)).when(
        same, F.when((G.overlap_ratio("l_", "r_", "x") >= config.x_overlap) & (gy <= config.vertical_times * F.col("y_threshold")), 2).when((gx <= F.col("x_threshold")) & (gy <= F.col("y_threshold")), 3)
    )
    return p.withColumn("rule", rule.cast("bigint")).where("rule is not null").select(F.col("l_file_id").alias("file_id"), F.col("l_page").alias("page"), F.col("l_word_id").alias("a"), F.col("r_word_id").alias("b"), "rule")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _joined(nodes: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """For each node of a page the least node that is connected with it."""
    out = []
    for ids, left, right in zip(nodes.to_pylist(), a.to_pylist(), b.to_pylist()):
        parent = {i: i for i in ids}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for x, y in zip(left or (), right or ()):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        out.append([find(i) for i in ids])
    return pa.array(out, pa.list_(pa.int64()))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, page, word_id, cluster: connected words of a page, named by their smallest word_id.

    A page's words and edges are one row for a union-find over Arrow batches; pages are many and bounded.
    """
    n = spread(nodes, *PAGE).groupBy(*PAGE).agg(F.collect_list("word_id").alias("ids"))
    e = spread(edges, *PAGE).groupBy(*PAGE).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    both = n.join(e, PAGE, "left").withColumn("cluster", _joined("ids", "a", "b"))
    return both.select(*PAGE, F.explode(F.arrays_zip(F.col("ids").alias("word_id"), "cluster")).alias("z")).select(*PAGE, "z.word_id", "z.cluster")


def clusters(words: DataFrame, config: Config = Config(), measures: DataFrame | None = None) -> DataFrame:
    """``words`` with cluster and the cluster's box (c_x0 ...)."""
    c = components(words, cluster_edges(words, config, measures))
    both = words.join(c, [*PAGE, "word_id"])
    w = Window.partitionBy(*PAGE, "cluster")
    return both.select("*", *[(F.min if s[1] == "0" else F.max)(s).over(w).alias(f"c_{s}") for s in BOX])


def reading_order(words: DataFrame, config: Config = Config()) -> DataFrame:
    """file_id, page, word_id, cluster, band, row, position: clusters in bands from top to bottom, in a band from left to right, in a cluster row by row."""
    words = cut(words)
    measures = page_measures(words, config)
    fuzz = measures.select(*PAGE, "fuzz")
    c = cut(clusters(words, config, measures))
    one = c.select(*PAGE, "cluster", "c_x0", "c_y0", "c_y1").distinct().join(fuzz, PAGE)
    by_top = Window.partitionBy(*PAGE).orderBy("c_y0", "cluster")
    low = F.max("c_y1").over(by_top.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("_new", F.when(F.col("c_y0") > low + F.col("fuzz"), 1).otherwise(0)).withColumn("band", F.sum("_new").over(by_top.rowsBetween(Window.unboundedPreceding, 0))).select(*PAGE, "cluster", "band")
    r = rows(c, fuzz, [*PAGE, "cluster"]).join(one, [*PAGE, "cluster"])
    w = Window.partitionBy(*PAGE).orderBy("band", "c_x0", "c_y0", "cluster", "row", "x0", "cy", "word_id")
    return r.select(*PAGE, "word_id", "cluster", F.col("band").cast("bigint").alias("band"), F.col("row").cast("bigint").alias("row"), (F.row_number().over(w) - 1).cast("bigint").alias("position"))


def cluster_outliers(clustered: DataFrame, config: Config = Config()) -> DataFrame:
    """file_id, page, cluster, word_id of words behind a gap above ``outlier_times`` the cluster's mean gap, on the side farther from its centroid,
    and front: whether such a word belongs in front of its cluster (twice dx plus dy from the centroid positive) or at its end."""
    c = _centers(clustered)
    mid = Window.partitionBy(*PAGE, "cluster")
    w = mid.orderBy("cy", "cx", "word_id")
    c = c.withColumn("mx", F.avg("cx").over(mid)).withColumn("my", F.avg("cy").over(mid))
    far = F.sqrt(F.pow(F.col("cx") - F.col("mx"), 2) + F.pow(F.col("cy") - F.col("my"), 2))
    step = F.sqrt(F.pow(F.lead("cx").over(w) - F.col("cx"), 2) + F.pow(F.lead("cy").over(w) - F.col("cy"), 2))
    c = c.withColumn("far", far).withColumn("step", step).withColumn("far2", F.lead("far").over(w)).withColumn("id2", F.lead("word_id").over(w)).withColumn("mean", F.avg("step").over(mid))
    hit = c.where((F.col("step") > config.outlier_times * F.col("mean"))).withColumn("word_id", F.when(F.col("far") > F.col("far2"), F.col("word_id")).otherwise(F.col("id2")))
    who = hit.select(*PAGE, "cluster", "word_id").distinct()
    return who.join(c.select(*PAGE, "word_id", "cx", "cy", "mx", "my"), [*PAGE, "word_id"]).select(*PAGE, "cluster", "word_id", (2 * (F.col("mx") - F.col("cx")) + (F.col("my") - F.col("cy")) > 0).alias("front"))


def reconstruct_lines(words: DataFrame, order: str = "word_id") -> DataFrame:
    """file_id, page, line, text, box, n_words: a word stays on the line while its center is within one and a half mean heights of the line's running
    center and it does not fall back by two heights; the line's box grows with it. One fold per page over its words in order."""
    w = words.where(F.coalesce("text", F.lit("")) != "")
    item = F.struct(F.col(order).alias("o"), "text", *BOX)
    kind = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,last:double,n:bigint>>"

    def add(s: Column, x: Column) -> Column:
        line = F.element_at(s, -1)
        near = F.abs((x["y0"] + x["y1"]) / 2 - (line["y0"] + line["y1"]) / 2) <= 1.5 * F.col("tall")
        back = x["x0"] < line["last"] - 2 * F.col("tall")
        fresh = F.array_append(s, F.struct(x["text"].alias("text"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["x0"].alias("last"), F.lit(1).cast("bigint").alias("n")))
        grown = F.struct(F.concat_ws(" ", line["text"], x["text"]).alias("text"), F.least(line["x0"], x["x0"]).alias("x0"), F.least(line["y0"], x["y0"]).alias("y0"), F.greatest(line["x1"], x["x1"]).alias("x1"), F.greatest(line["y1"], x["y1"]).alias("y1"), x["x0"].alias("last"), (line["n"] + 1).alias("n"))
        more = F.array_append(F.slice(s, F.lit(1), F.size(s) - 1), grown)
        return F.when(F.size(s) == 0, fresh).when(near & ~back, more).otherwise(fresh)

    page = w.groupBy(*PAGE).agg(F.avg(F.when(G.height() > 0, G.height())).alias("tall"), F.array_sort(F.collect_list(item)).alias("w"))
    lines = page.select(*PAGE, F.posexplode(F.aggregate("w", F.array().cast(kind), add)).alias("line", "l"))
    return lines.select(*PAGE, F.col("line").cast("bigint").alias("line"), "l.text", *[F.col(f"l.{b}").alias(b) for b in BOX], F.col("l.n").alias("n_words"))


def order_concordance(order: DataFrame, truth: str = "word_id") -> DataFrame:
    """file_id, page, concordance: (concordant - discordant) of all pairs of a page's words, in reading order and in true order, as a share of the
    pairs; 1 for pages of one word.

    Discordant pairs are the inversions of the positions in true order. They are counted level by level, as a merge sort does: two positions whose
    binary digits first differ at a digit are apart by that digit, so at each of the levels one window counts, among the positions that
    agree in all higher digits, the ones with digit 1 that stand before one with digit 0. Nothing pairs all words of a page.
    """
    t = Window.partitionBy(*PAGE)
    r = order.select(*PAGE, (F.row_number().over(t.orderBy("position")) - 1).cast("long").alias("p"), F.row_number().over(t.orderBy(truth)).alias("t"))
    top = F.greatest(F.ceil(F.log2(F.count(F.lit(1)).over(t).cast("double"))), F.lit(1))
    r = r.withColumn("_top", top - 1).select(*PAGE, "t", "p", F.explode(F.sequence(F.lit(0).cast("long"), "_top")).alias("level"))
    r = r.withColumn("digit", F.expr("getbit(p, cast(level as int))")).withColumn("above", F.expr("shiftright(p, cast(level as int) + 1)"))
    ones = F.sum("digit").over(Window.partitionBy(*PAGE, "level", "above").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("before", F.when(F.col("digit") == 0, F.coalesce(ones, F.lit(0))).otherwise(0))
    c = r.groupBy(*PAGE).agg(F.sum("before").alias("wrong"), F.count_if(F.col("level") == 0).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return c.select(*PAGE, F.when(pairs > 0, (pairs - 2 * F.col("wrong")) / pairs).otherwise(1.0).alias("concordance"))

"""Fusing free text of a page (from a vision-language model) with located words: alignment, segments without place, placement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from leafspan.functions import geometry as G
from leafspan.functions.text import tokens
from leafspan.operators import layout as L
from leafspan.operators.matching import BOX, PAGE
from leafspan.session import cut, spread

#: Fixed values of the placement: page width, its margins, the indent within them, extra line height, space in character widths, sizes where nothing
#: is known, the gap beside an anchor, the line where nothing is known, the margin of a cluster's box and of a search area.
PAGE_WIDTH, MARGIN, INDENT, LEADING, SPACE, CHAR_W, CHAR_H = 612.0, 50.0, 10.0, 5.0, 0.3, 10.0, 15.0
BESIDE, FIRST_LINE, AROUND, SEARCH = 2.0, 100.0, 20.0, 5.0


def tokenised(pages: DataFrame, text: str = "vlm_text") -> DataFrame:
    """file_id, page, idx, token of a text per page."""
    return pages.select(*PAGE, F.posexplode(tokens(F.coalesce(text, F.lit("")))).alias("idx", "token")).withColumn("idx", F.col("idx").cast("bigint"))


def context_signatures(rows: DataFrame, text: str, order: str, width: int) -> DataFrame:
    """``rows`` with context: the texts from ``width`` before to ``width`` behind, joined by spaces."""
    w = Window.partitionBy(*PAGE).orderBy(order).rowsBetween(-width, width)
    return rows.withColumn("context", F.array_join(F.collect_list(F.col(text)).over(w), " "))


def char_sizes(words: DataFrame) -> DataFrame:
    """file_id, page, char_w, char_h, std_w, std_h: mean and sample deviation of the size of a character."""
    w = words.where((F.length("text") > 0) & (G.width() > 0) & (G.height() > 0)).withColumn("cw", G.width() / F.length("text")).withColumn("ch", G.height())
    a = w.groupBy(*PAGE).agg(F.avg("cw").alias("char_w"), F.avg("ch").alias("char_h"), F.coalesce(F.stddev_samp("cw"), F.lit(0.0)).alias("std_w"), F.coalesce(F.stddev_samp("ch"), F.lit(0.0)).alias("std_h"))
    return words.select(*PAGE).distinct().join(a, PAGE, "left").na.fill({"char_w": CHAR_W, "char_h": CHAR_H, "std_w": 0.0, "std_h": 0.0})


def char_size_clusters(words: DataFrame) -> DataFrame:
    """file_id, page, cluster, n, mean_h: heights in ascending order join a cluster within two deviations of its running mean (at least one point). One fold per page."""
    kind = "array<struct<n:bigint,s:double,q:double>>"
    item = lambda x: F.struct(F.lit(1).cast("bigint").alias("n"), x.alias("s"), (x * x).alias("q"))

    def add(s: Column, x: Column) -> Column:
        c = F.element_at(s, -1)
        mean = c["s"] / c["n"]
        dev = F.sqrt(F.greatest(c["q"] / c["n"] - mean * mean, F.lit(0.0)))
        dev = F.when(dev > 0, dev).otherwise(1.0)
        more = F.array_append(F.slice(s, F.lit(1), F.size(s) - 1), F.struct((c["n"] + 1).alias("n"), (c["s"] + x).alias("s"), (c["q"] + x * x).alias("q")))
        return F.when(F.size(s) == 0, F.array_append(s, item(x))).when(F.abs(x - mean) <= 2 * dev, more).otherwise(F.array_append(s, item(x)))

    h = words.where(G.height() > 0).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.round(G.height(), 6))).alias("h"))
    c = h.select(*PAGE, F.posexplode(F.aggregate("h", F.array().cast(kind), add)).alias("cluster", "c"))
    return c.select(*PAGE, F.col("cluster").cast("bigint").alias("cluster"), F.col("c.n").alias("n"), F.round(F.col("c.s") / F.col("c.n"), 9).alias("mean_h"))


def _distance(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


class _Nearest:
    """The nearest of some texts. An edit changes the counts of signs by one up and one down at most, so the counts of all texts, compared at
    once, leave few whose distance has to be worked out."""

    SIGNS = 64

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.counts = np.zeros((len(texts), self.SIGNS), np.int16)
        for i, t in enumerate(texts):
            self.counts[i] = self._count(t)
        self.free = np.ones(len(texts), bool)

    def _count(self, text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % self.SIGNS, minlength=self.SIGNS)

    def find(self, text: str, most: int) -> int | None:
        """The first of the nearest free texts within ``most`` edits."""
        apart = self.counts - self._count(text)
        bound = np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1))
        best = (most + 1, -1)
        for j in np.flatnonzero(self.free & (bound <= most)).tolist():
            best = min(best, (_distance(text, self.texts[j], min(most, best[0])), j))
        return best[1] if best[0] <= most else None


def align_page(vlm: list[str], ocr: list[str]) -> dict[int, tuple[int, int]]:
    """Token -> (word, pass): for short texts equal words in order, then the nearest within three edits; else by unique equal context, then by the nearest
    context, then by the nearest text. Comparison is in lower case, and a word is taken once."""
    out: dict[int, tuple[int, int]] = {}
    free = dict.fromkeys(range(len(ocr)))
    v, o = [t.lower() for t in vlm], [t.lower() for t in ocr]
    texts = _Nearest(o)
    looked = [texts]

    def take(i: int, j: int, step: int) -> None:
        out[i] = (j, step)
        free.pop(j)
        for n in looked:
            n.free[j] = False

    if len(v) <= 3:
        for i, t in enumerate(v):
            if (j := next((j for j in free if o[j] == t), None)) is not None:
                take(i, j, 1)
        for i, t in enumerate(v):
            if i not in out and (j := texts.find(t, 3)) is not None:
                take(i, j, 4)
        return out
    around = lambda words, i, w: " ".join(words[max(0, i - w) : i + w + 1])
    contexts = {w: ([around(v, i, w) for i in range(len(v))], [around(o, j, w) for j in range(len(o))]) for w in range(1, 5)}
    places = {w: {} for w in contexts}
    for w, (_, oc) in contexts.items():
        for j, c in enumerate(oc):
            places[w].setdefault(c, []).append(j)
    for i in range(len(v)):
        for w in range(1, 5):
            hits = [j for j in places[w].get(contexts[w][0][i], ()) if j in free]
            if len(hits) == 1:
                take(i, hits[0], 2)
                break
    near = {w: _Nearest(oc) for w, (_, oc) in contexts.items()}
    for n in near.values():
        n.free = texts.free  # one set of free words for all
    for most in range(1, 4):
        for i in range(len(v)):
            if i in out:
                continue
            for w in range(1, 5):
                if (j := near[w].find(contexts[w][0][i], most)) is not None:
                    take(i, j, 3)
                    break
    for i, t in enumerate(v):
        if i not in out and (j := texts.find(t, 3)) is not None:
            take(i, j, 4)
    return out


_HIT = pa.list_(pa.struct([("at", pa.int32()), ("step", pa.int64())]))


@F.arrow_udf(from_arrow_type(_HIT))
def _hits(vlm: pa.Array, ocr: pa.Array) -> pa.Array:
    out = []
    for v, o in zip(vlm.to_pylist(), ocr.to_pylist()):
        got = align_page(v, o or [])
        out.append([{"at": got[k][0], "step": got[k][1]} if k in got else None for k in range(len(v))])
    return pa.array(out, _HIT)


def align(vlm: DataFrame, words: DataFrame, order: str = "word_id") -> DataFrame:
    """file_id, page, idx, token, word_id (null where none was found), step: the words of each page's text with the located word they stand for.

    A page is one row of two arrays: its size has nothing to do with the tables'."""
    t = spread(vlm, *PAGE).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("idx", "token"))).alias("t"))
    w = spread(words.where(F.coalesce("text", F.lit("")) != ""), *PAGE).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "word_id", "text"))).alias("w"))
    both = t.join(w, PAGE, "left").withColumn("h", _hits(F.transform("t", lambda x: x["token"]), F.transform("w", lambda x: x["text"])))
    one = both.select(*PAGE, "w", F.explode(F.arrays_zip("t", "h")).alias("z"))
    return one.select(*PAGE, "z.t.idx", "z.t.token", F.when(F.col("z.h").isNotNull(), F.get("w", F.col("z.h.at"))["word_id"]).alias("word_id"), "z.h.step")


def orphan_segments(aligned: DataFrame) -> DataFrame:
    """file_id, page, segment, first_idx, last_idx, n, text, left_id, right_id: runs of tokens without a word, with the located words on either side."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    a = aligned.withColumn("left_id", F.last("word_id", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("right_id", F.first("word_id", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    o = a.where("word_id is null").withColumn("_run", F.col("idx") - F.row_number().over(w))
    s = o.groupBy(*PAGE, "_run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]), " ").alias("text"), F.min(F.struct("idx", "left_id"))["left_id"].alias("left_id"), F.max(F.struct("idx", "right_id"))["right_id"].alias("right_id"))
    return s.withColumn("segment", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first_idx")).cast("bigint") - 1).drop("_run")


def interpolated(prefix_left: str = "l_", prefix_right: str = "r_") -> list[Column]:
    """The box of a text between two anchors: in the gap on one line, as wide as there is room, on the mean of their lines; behind the left anchor, on its
    line, across lines and where it is the only one; in front of the right one where that is; in a fixed place without any."""
    l, r = prefix_left, prefix_right
    has_l, has_r = F.col(f"{l}x0").isNotNull(), F.col(f"{r}x0").isNotNull()
    between = has_l & has_r & G.same_line(l, r)
    wide = F.col("char_w") * F.length("text")
    behind = F.col(f"{l}x1") + BESIDE
    room = F.col(f"{r}x0") - behind - BESIDE
    front = F.col(f"{r}x0") - BESIDE
    x0 = F.when(has_l, behind).when(has_r, F.greatest(F.lit(0.0), front - wide)).otherwise(MARGIN)
    x1 = F.when(between, behind + F.when(room > 0, F.least(wide, room)).otherwise(wide)).when(~has_l & has_r, front).otherwise(x0 + wide)
    line = lambda y, none: F.when(between, (F.col(f"{l}{y}") + F.col(f"{r}{y}")) / 2).when(has_l, F.col(f"{l}{y}")).when(has_r, F.col(f"{r}{y}")).otherwise(none)
    return [x0.alias("x0"), line("y0", F.lit(FIRST_LINE)).alias("y0"), F.when(x1 <= x0, x0 + wide).otherwise(x1).alias("x1"), line("y1", FIRST_LINE + F.col("char_h")).alias("y1")]


def wrapped(words: Column, start_x: Column, start_y0: Column, start_y1: Column, char_w: Column, char_h: Column, left: Column | float = MARGIN, right: Column | float = PAGE_WIDTH - MARGIN) -> Column:
    """Array of (text, x0, y0, x1, y1): words set from a point on, with spaces between them; one that does not fit before ``right`` begins a new line
    at ``left``, both less an indent."""
    left, right = (F.lit(x) if isinstance(x, float) else x for x in (left, right))
    place = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
    init = F.struct(*[c.cast("double").alias(n) for n, c in (("x", start_x), ("y0", start_y0), ("y1", start_y1))], F.array().cast(place).alias("out"))

    def put(s: Column, t: Column) -> Column:
        w = char_w * F.length(t)
        wrap = s["x"] + w > right - INDENT
        x, down = F.when(wrap, left + INDENT).otherwise(s["x"]), F.when(wrap, char_h + LEADING).otherwise(0.0)
        y0, y1 = s["y0"] + down, s["y1"] + down
        return F.struct((x + w + SPACE * char_w).alias("x"), y0.alias("y0"), y1.alias("y1"), F.array_append(s["out"], F.struct(t.alias("text"), x.alias("x0"), y0.alias("y0"), (x + w).alias("x1"), y1.alias("y1"))).alias("out"))

    return F.aggregate(words, init, put)["out"]


def cluster_of(points: DataFrame, clusters: DataFrame, key: list[str], margin: float = AROUND) -> DataFrame:
    """``key``, cluster and its x0 and x1 (c_x0, c_x1) for each of ``points`` (page, key, px, py): the first cluster of the page whose box, with a margin, holds
    the point, else the one whose middle is nearest. ``clusters`` has a row per page and cluster with its box c_x0 ... c_y1."""
    c = clusters.select(*PAGE, "cluster", *[f"c_{b}" for b in BOX])
    p = points.join(c, PAGE)
    inside = F.col("px").between(F.col("c_x0") - margin, F.col("c_x1") + margin) & F.col("py").between(F.col("c_y0") - margin, F.col("c_y1") + margin)
    far = F.sqrt(F.pow(F.col("px") - (F.col("c_x0") + F.col("c_x1")) / 2, 2) + F.pow(F.col("py") - (F.col("c_y0") + F.col("c_y1")) / 2, 2))
    best = F.min(F.struct((~inside).alias("o"), F.when(inside, 0.0).otherwise(far).alias("far"), "cluster", "c_x0", "c_x1"))
    return p.groupBy(*PAGE, *key).agg(best.alias("b")).select(*PAGE, *key, "b.cluster", "b.c_x0", "b.c_x1")


def placed_on_regions(segments: DataFrame, regions: DataFrame, words: DataFrame) -> DataFrame:
    """page, segment, k, box: the words of segments that find a text region each in the area where they must stand: between the anchors on one line, to the right
    of the left one, or to the left of the right one.

    A region is 5 points wide and high or more, lies in the area and overlaps no located word (IoU above 0.3). It belongs to the first segment
    that it can serve. A segment is placed if there are as many regions as words and each, in order, is half as wide as its word at least.
    """
    has_l, has_r = F.col("l_x0").isNotNull(), F.col("r_x0").isNotNull()
    line = has_l & has_r & G.same_line("l_", "r_")
    area = {
        "ax0": F.when(has_l, F.col("l_x1")).otherwise(MARGIN),
        "ax1": F.when(line | ~has_l, F.col("r_x0")).otherwise(PAGE_WIDTH - MARGIN),
        "ay0": F.when(line, F.least("l_y0", "r_y0")).otherwise(F.coalesce("l_y0", "r_y0")) - SEARCH,
        "ay1": F.when(line, F.greatest("l_y1", "r_y1")).otherwise(F.coalesce("l_y1", "r_y1")) + SEARCH,
    }
    free = regions.where((G.width() >= 5) & (G.height() >= 5)).select(*PAGE, *BOX).distinct().withColumn("region", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "x1", "y1")))
    taken = L.banded_pairs(free, words.select(*PAGE, *BOX)).where(G.iou("l_", "r_") > 0.3).select(*[F.col(f"l_{c}").alias(c) for c in (*PAGE, "region")]).distinct()
    free = free.join(taken, [*PAGE, "region"], "left_anti")
    s = segments.where(has_l | has_r).select(*PAGE, "segment", "n", "text", "char_w", *[c.alias(k) for k, c in area.items()])
    hit = s.join(free, PAGE).where("x0 >= ax0 and x1 <= ax1 and y0 >= ay0 and y1 <= ay1")
    own = hit.withColumn("_first", F.min("segment").over(Window.partitionBy(*PAGE, "region"))).where("segment = _first")
    own = own.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, "segment").orderBy("region")) - 1).where("k < n")
    own = own.withColumn("_wide", G.width() >= 0.5 * F.length(F.get(tokens(F.col("text")), F.col("k"))) * F.col("char_w"))
    whole = Window.partitionBy(*PAGE, "segment")
    own = own.withColumn("_all", F.count_if("_wide").over(whole)).where("_all = n")
    return own.select(*PAGE, "segment", F.col("k").cast("bigint").alias("k"), *BOX)


def fuse(vlm: DataFrame, words: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """file_id, page, position, text, box, status, confidence: text of the page with the places of its words, in reading order.

    Matched words keep their box (vlm_matched, 1.0 if the text is the located word's, else 0.9); runs without place are set on the ``regions`` found in pixels
    where they must stand (vlm_pixel_placed, 0.8), otherwise behind their left anchor, wrapping within its cluster (vlm_interpolated, 0.7);
    located words that no text has are kept with their confidence (ocr_only). A page without text has only those, a page without located words nothing.
    """
    words = cut(words.where(F.coalesce("text", F.lit("")) != ""))
    a = cut(align(vlm, words))
    boxes = words.select("word_id", F.col("text").alias("_own"), *BOX)
    sure = F.col("confidence") if "confidence" in words.columns else F.lit(0.0)
    got = a.where("word_id is not null").join(boxes, "word_id")
    matched = got.select(*PAGE, F.col("idx").alias("o"), F.lit(0).cast("bigint").alias("k"), F.col("token").alias("text"), *BOX, F.lit("vlm_matched").alias("status"), F.when(F.col("token") == F.col("_own"), 1.0).otherwise(0.9).alias("confidence"))
    sizes = char_sizes(got.select(*PAGE, F.col("token").alias("text"), *BOX).unionByName(words.select(*PAGE, F.lit("").alias("text"), *BOX)))
    s = orphan_segments(a.join(words.select(*PAGE).distinct(), PAGE, "left_semi")).join(sizes, PAGE)
    for side, p in (("left_id", "l_"), ("right_id", "r_")):
        s = s.join(words.select(F.col("word_id").alias(side), *[F.col(b).alias(f"{p}{b}") for b in BOX]), side, "left")
    s = cut(s)
    grouped = L.clusters(words).select(*PAGE, "cluster", *[f"c_{b}" for b in BOX]).distinct()
    anchor = lambda c: F.coalesce(F.col(f"l_{c}"), F.col(f"r_{c}"))
    points = s.where("left_id is not null or right_id is not null").select(*PAGE, "segment", ((anchor("x0") + anchor("x1")) / 2).alias("px"), ((anchor("y0") + anchor("y1")) / 2).alias("py"))
    s = s.join(cluster_of(points, grouped, ["segment"]), [*PAGE, "segment"], "left")
    left, right = F.coalesce("c_x0", F.lit(MARGIN)), F.coalesce("c_x1", F.lit(PAGE_WIDTH - MARGIN))
    has_l = F.col("left_id").isNotNull()
    x = F.when(has_l, F.col("l_x1") + SPACE * F.col("char_w")).otherwise(left + INDENT)
    y0, y1 = F.coalesce("l_y0", "r_y0", F.lit(FIRST_LINE)), F.coalesce("l_y1", "r_y1", FIRST_LINE + F.col("char_h"))
    set_ = s.select(*PAGE, "segment", "first_idx", F.posexplode(wrapped(tokens(F.col("text")), x, y0, y1, F.col("char_w"), F.col("char_h"), left, right)).alias("k", "w")).withColumn("k", F.col("k").cast("bigint"))
    if regions is not None:
        pixel = placed_on_regions(s, regions, words).select(*PAGE, "segment", "k", F.struct(*BOX).alias("p"))
        set_ = set_.join(pixel, [*PAGE, "segment", "k"], "left")
    else:
        set_ = set_.withColumn("p", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    placed = set_.select(*PAGE, (F.col("first_idx") + F.col("k")).alias("o"), "k", "w.text", *[F.coalesce(f"p.{b}", f"w.{b}").alias(b) for b in BOX], F.when(F.col("p").isNull(), "vlm_interpolated").otherwise("vlm_pixel_placed").alias("status"), F.when(F.col("p").isNull(), 0.7).otherwise(0.8).alias("confidence"))
    only = words.join(got.select("word_id"), "word_id", "left_anti").select(*PAGE, (F.lit(1 << 40) + F.col("word_id")).alias("o"), F.lit(0).cast("bigint").alias("k"), "text", *BOX, F.lit("ocr_only").alias("status"), sure.cast("double").alias("confidence"))
    all_ = cut(matched.unionByName(placed).unionByName(only).withColumn("word_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy("o", "k")).cast("bigint")))
    order = L.reading_order(all_.select(*PAGE, "word_id", "text", *BOX)).select(*PAGE, "word_id", "position")
    return all_.join(order, [*PAGE, "word_id"]).select(*PAGE, "position", "text", *BOX, "status", "confidence")

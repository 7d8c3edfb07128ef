"""Problem 4: rows of different sources that stand for the same thing, without a common key.

Rows are shared out by page once and stay there: bringing them to one coordinate system (units, then a shift and a stretch per source, fitted
on texts that occur once in each source) takes windows over that partitioning and no shuffle. Candidates come from an equi-join on page and
line band. Matching functions vote on each candidate; a generative model of the votes learns, by expectation maximisation over the bounded number
of vote patterns, how accurate each function is and which of them say the same thing twice, and gives each candidate a posterior.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.session import cut
from leafspan.sources import table

PAGE = ["file_id", "page"]
#: All distances are in heights of a word of the page (the least of its sources' median heights). How far apart centers and edges of candidates
#: may be; how near and how far lines and edges have to be for a vote; what stands on one line.
MAX_DY, MAX_GAP = 0.95, 0.42
LINE_NEAR, LINE_FAR, EDGE_NEAR, EDGE_FAR, ROW = 0.36, 0.62, 0.42, 0.93, 0.72
#: How far a source may be shifted, across and down; how far a fitted word may be from the median shift; the spread from which a stretch is fitted.
SHIFT, REST, SPREAD = (4.6, 3.6), (1.05, 1.25), 2.0
#: Dots per inch that boxes in pixels may come from, and the size of pages of which none is known, in points.
RESOLUTIONS = (96, 100, 120, 144, 150, 200, 240, 300, 400, 600)
WIDTH, HEIGHT = 612.0, 792.0
VOTES = ["overlap", "extent", "line", "edge", "reading", "part", "neighbours", "speck"]


def _per(*more: str):
    """The window of a page, or of what shares ``more`` columns on it."""
    return Window.partitionBy(*PAGE, *more)


def _folded(text: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def rows_in_points(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Deduplicated rows with canonical source names, boxes in page points and u, the height of a word: boxes given as shares of the page and boxes in
    pixels are told by the median height of a source's words on the page, against the least median of the page."""
    r = rows.select(*PAGE, F.col("word_id").alias("id"), F.lower(F.trim("engine")).alias("engine"), F.coalesce("text", F.lit("")).alias("text"), "x0", "y0", "x1", "y1").repartition(*PAGE).distinct()
    size = pages.groupBy(*PAGE).agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    r = r.join(size, PAGE, "left").withColumn("_tall", F.percentile(F.col("y1") - F.col("y0"), 0.5).over(_per("engine")))
    ratio = F.col("_tall") / F.min(F.when(F.col("_tall") >= 1, F.col("_tall"))).over(_per())
    steps = F.array(*[F.lit(dpi / 72) for dpi in RESOLUTIONS])
    near = F.array_min(F.transform(steps, lambda s: F.struct(F.abs(F.log(s / F.col("_ratio"))).alias("by"), s.alias("s"))))["s"]
    shrink = F.when(F.col("_tall") < 1, None).when(F.col("_ratio") > 1.25, 1 / near).otherwise(1.0)
    r = r.withColumn("_ratio", ratio).withColumn("_k", shrink)
    kx, ky = F.coalesce("_k", "_w", F.lit(WIDTH)), F.coalesce("_k", "_h", F.lit(HEIGHT))
    r = r.select(*PAGE, "engine", "id", "text", _folded(F.col("text")).alias("key"), (F.col("x0") * kx).alias("x0"), (F.col("y0") * ky).alias("y0"), (F.col("x1") * kx).alias("x1"), (F.col("y1") * ky).alias("y1"), (F.col("_tall") * ky).alias("_tall"))
    return r.withColumn("u", F.greatest(F.min(F.when(F.col("_tall") > 0, F.col("_tall"))).over(_per()), F.lit(1e-6))).drop("_tall")


def aligned(rows: DataFrame) -> DataFrame:
    """Rows with each source shifted and stretched onto the page's largest source, by regression over the words that both read
    once; a source with fewer than four such words is only shifted, with none left as it is."""
    r = rows.withColumn("_n", F.count(F.lit(1)).over(_per("engine")))
    r = r.withColumn("_hub", F.max(F.struct("_n", "engine")).over(_per())["engine"])
    r = r.withColumn("_once", (F.length("key") >= 3) & (F.count(F.lit(1)).over(_per("engine", "key")) == 1))
    mid = {c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xy"}
    key = _per("key")
    # where the largest source has the word; a word counts where both are within reach
    r = r.select("*", *[F.max(F.when(F.col("_once") & (F.col("engine") == F.col("_hub")), mid[c])).over(key).alias(f"_h{c}") for c in "xy"])
    reach = F.col("_once") & (F.abs(F.col("_hx") - mid["x"]) < SHIFT[0] * F.col("u")) & (F.abs(F.col("_hy") - mid["y"]) < SHIFT[1] * F.col("u"))
    r = r.select("*", *[F.when(reach, F.col(f"_h{c}") - mid[c]).alias(f"_d{c}") for c in "xy"])
    r = r.select("*", *[F.percentile(f"_d{c}", 0.5).over(_per("engine")).alias(f"_m{c}") for c in "xy"])
    fits = (F.abs(F.col("_dx") - F.col("_mx")) < REST[0] * F.col("u")) & (F.abs(F.col("_dy") - F.col("_my")) < REST[1] * F.col("u"))
    r = r.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_f", F.count_if("_fits").over(_per("engine")))
    out = []
    for c in "xy":
        there, here = F.when(F.col("_fits"), F.col(f"_h{c}")), F.when(F.col("_fits"), mid[c])
        slope, start = F.regr_slope(there, here).over(_per("engine")), F.regr_intercept(there, here).over(_per("engine"))
        stretch = (F.col("_f") >= 4) & (F.stddev_pop(here).over(_per("engine")) > SPREAD * F.col("u")) & slope.between(0.9, 1.1)
        out += [F.when(stretch, slope).otherwise(1.0).alias(f"_a{c}"), F.when(stretch, start).otherwise(F.coalesce(F.avg(F.when(F.col("_fits"), F.col(f"_d{c}"))).over(_per("engine")), F.lit(0.0))).alias(f"_b{c}")]
    r = r.select("*", *out)
    return r.select(*PAGE, "engine", "id", "text", "key", "u", *[(F.col(f"{c}{i}") * F.col(f"_a{c}") + F.col(f"_b{c}")).alias(f"{c}{i}") for i in (0, 1) for c in "xy"])


def with_neighbours(rows: DataFrame) -> DataFrame:
    """What candidates need of aligned rows: the middle of the line, and the texts before and behind in the row's own source."""
    order = _per("engine").orderBy(F.round(F.col("y0") / (ROW * F.col("u"))), "x0", "id")
    r = rows.withColumn("yc", (F.col("y0") + F.col("y1")) / 2).withColumn("before", F.lag("key").over(order)).withColumn("after", F.lead("key").over(order))
    return r.select(*PAGE, "engine", "id", "key", "u", "x0", "x1", "yc", "before", "after", F.when(F.col("key") == "", F.col("text")).alias("text"))


def candidates(r: DataFrame) -> DataFrame:
    """Pairs of rows (``with_neighbours``) of different sources near each other on a page, with the votes of the matching functions: 1 for, -1
    against, 0 abstention. The join is on page and line band; a row of one side stands in the two bands that it can reach."""
    band = lambda shift: F.floor((F.col("yc") + shift * MAX_DY * F.col("u")) / (2 * MAX_DY * F.col("u")))
    cols = ["engine", "id", "key", "x0", "x1", "yc", "before", "after", "text"]
    left = r.select(*PAGE, "u", band(0).alias("b"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = r.select(*PAGE, F.explode(F.array_distinct(F.array(band(-1), band(1)))).alias("b"), *[F.col(c).alias(f"r_{c}") for c in cols])
    u = F.col("u")
    dy = F.abs(F.col("l_yc") - F.col("r_yc"))
    near = (F.col("l_engine") < F.col("r_engine")) & (dy <= MAX_DY * u) & (F.col("l_x0") <= F.col("r_x1") + MAX_GAP * u) & (F.col("r_x0") <= F.col("l_x1") + MAX_GAP * u)
    p = left.join(right, [*PAGE, "b"]).where(near)
    lw, rw = F.greatest(F.col("l_x1") - F.col("l_x0"), F.lit(0.1)), F.greatest(F.col("r_x1") - F.col("r_x0"), F.lit(0.1))
    over = F.greatest(F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0"), F.lit(0.0))
    inner, outer = over / F.least(lw, rw), over / (lw + rw - over)
    edge = F.least(F.abs(F.col("l_x0") - F.col("r_x0")), F.abs(F.col("l_x1") - F.col("r_x1")))
    ll, rl = F.length("l_key"), F.length("r_key")
    equal = F.col("l_key") == F.col("r_key")
    share = lambda d, n: F.when(equal, 0.0).otherwise(d / F.greatest(n, F.lit(1)))
    alike = 1 - share(F.levenshtein("l_key", "r_key"), F.greatest(ll, rl))
    short, long = F.when(ll <= rl, F.col("l_key")).otherwise(F.col("r_key")), F.when(ll <= rl, F.col("r_key")).otherwise(F.col("l_key"))
    n = F.least(ll, rl)
    ends = share(F.least(F.levenshtein(short, F.substr(long, F.lit(1), n)), F.levenshtein(short, F.right(long, n))), n)
    same = lambda a, b: (F.col(a) == F.col(b)) | (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)) >= 0.6)
    sides = [F.when(F.col(f"l_{s}").isNull() | F.col(f"r_{s}").isNull(), 0).when(same(f"l_{s}", f"r_{s}"), 1).otherwise(-1) for s in ("before", "after")]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    nothing = (ll == 0) | (rl == 0)
    signs = F.when(F.col("l_text") == F.col("r_text"), 1).otherwise(-1)
    p = p.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), inner.alias("inner"), outer.alias("outer"), (dy / u).alias("dy"), (edge / u).alias("edge"), alike.alias("alike"), ends.alias("ends"), (sides[0] + sides[1]).alias("sides"), nothing.alias("nothing"), signs.alias("signs"), n.alias("n"), (F.greatest(lw, rw) / F.least(lw, rw)).alias("wider"), F.contains(long, short).alias("inside"))
    c = F.col
    return p.select(
        "a",
        "b",
        vote(c("inner") >= 0.55, c("inner") < 0.2).alias("overlap"),
        vote(c("outer") >= 0.55, c("outer") < 0.12).alias("extent"),
        vote(c("dy") <= LINE_NEAR, c("dy") > LINE_FAR).alias("line"),
        vote(c("edge") <= EDGE_NEAR, c("edge") > EDGE_FAR).alias("edge"),
        F.when(c("nothing"), c("signs")).otherwise(vote(c("alike") >= 0.55, c("alike") < 0.3)).alias("reading"),
        F.when(c("nothing"), c("signs")).otherwise(vote((c("inside") & (c("n") >= 2)) | (c("ends") <= 0.34), c("ends") >= 0.67)).alias("part"),
        F.signum("sides").cast("int").alias("neighbours"),
        # one or two signs inside a word that is much wider and reads otherwise
        F.when((c("n") <= 2) & (c("wider") >= 2.5) & (c("nothing") | (~c("inside") & (c("ends") >= 0.67))), -1).otherwise(0).alias("speck"),
    )


def fit_label_model(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of every vote pattern. ``counts`` are the patterns and how often each occurs.

    Each function has, for matches and for others, a probability of each of its votes, learnt by expectation maximisation from a
    start in which the plain sum of votes decides. Functions that repeat each other within a class (correlated votes) share
    their weight: a function's log-odds are divided by one plus its summed absolute correlations with the others.
    """
    if not counts:
        return {}
    width = len(counts[0][0])
    total = sum(n for _, n in counts)
    post = {p: 1 / (1 + exp(-1.5 * sum(p))) for p, _ in counts}
    damp = [1.0] * width
    for round_ in range(rounds):
        mass = [sum(n * (1 - post[p]) for p, n in counts), sum(n * post[p] for p, n in counts)]
        prior = min(0.98, max(0.02, mass[1] / total))
        table_: list[list[dict[int, float]]] = []
        for c in (0, 1):
            seen = [{v: 0.5 for v in (-1, 0, 1)} for _ in range(width)]
            for p, n in counts:
                w = n * (post[p] if c else 1 - post[p])
                for j, v in enumerate(p):
                    seen[j][v] += w
            table_.append([{v: x / sum(s.values()) for v, x in s.items()} for s in seen])
        if round_ % 5 == 0:  # correlations within the classes
            corr = [[0.0] * width for _ in range(width)]
            for c in (0, 1):
                w = {p: n * (post[p] if c else 1 - post[p]) for p, n in counts}
                m = sum(w.values()) or 1.0
                mean = [sum(p[j] * x for p, x in w.items()) / m for j in range(width)]
                var = [sum((p[j] - mean[j]) ** 2 * x for p, x in w.items()) / m for j in range(width)]
                for i in range(width):
                    for j in range(width):
                        if i != j and var[i] > 1e-9 and var[j] > 1e-9:
                            cov = sum((p[i] - mean[i]) * (p[j] - mean[j]) * x for p, x in w.items()) / m
                            corr[i][j] += (m / total) * abs(cov) / (var[i] * var[j]) ** 0.5
            damp = [1 / (1 + sum(row)) for row in corr]
        new = {}
        for p, _ in counts:
            s = log(prior / (1 - prior)) + sum(damp[j] * log(table_[1][j][v] / table_[0][j][v]) for j, v in enumerate(p))
            new[p] = 1 / (1 + exp(-max(-30.0, min(30.0, s))))
        moved = max(abs(new[p] - post[p]) for p in new)
        post = new
        if moved < 1e-6:
            break
    return post


def link_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """word_a, word_b, confidence of every candidate pair, smaller id first.

    ``rows`` has file_id, page, word_id, engine, text and a box; repeated rows count once. Null texts count as empty; rows
    with null page, engine or box have no candidates; pages without metadata are taken as 612 x 792 points. An empty table
    gives an empty result. The vote patterns that the driver sees number at most 3 to the power of the functions.
    """
    located = rows_in_points(rows.where("file_id is not null and page is not null and engine is not null"), pages)
    # both sides of the pairs come from one table, so the alignment is worked out once
    pairs = cut(candidates(cut(with_neighbours(aligned(located)))))
    counts = [(tuple(r[v] for v in VOTES), r["count"]) for r in pairs.groupBy(*VOTES).count().collect()]
    post = fit_label_model(counts)
    scores = rows.sparkSession.createDataFrame([(*p, float(x)) for p, x in post.items()], ", ".join([*[f"{v} int" for v in VOTES], "confidence double"]))
    # at most 3^8 rows
    return pairs.join(F.broadcast(scores), VOTES).select(F.col("a").alias("word_a"), F.col("b").alias("word_b"), F.round("confidence", 6).alias("confidence"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "engine_words").select(*PAGE, "word_id", "engine", "text", "x0", "y0", "x1", "y1")
    return link_rows(rows, table(spark, sf_dir, "pages_meta").select(*PAGE, "width", "height"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("confidence >= 0.5").select("word_a", "word_b")


QUERIES = {"p4_found": found, "p4_links": _links}
ORACLE: dict[str, str] = {}

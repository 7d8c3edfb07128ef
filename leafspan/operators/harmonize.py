"""Harmonising several engines' readings of a page: matching, weighted votes, words that only secondaries have, fragments.

Engines are values of a column. Every step is a join or an aggregation keyed by page (or by page and engine); one fold per page,
over the few secondary words that are left, keeps the order-dependent part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import geometry as G
from leafspan.functions.text import compare_key, concatenated, garbage, similarity, word_at
from leafspan.operators.matching import BOX, PAGE, WordMatch, banded_pairs, greedy_assign, match_score, span
from leafspan.session import cut


@dataclass(frozen=True)
class Engine:
    weight: float = 1.0
    garbage_penalty: float = 0.1
    iou: float | None = None
    center_distance: float | None = None
    letter: str = ""
    enabled: bool = True
    #: Whether its rows are lines, which give a word by its place, and not words.
    lines: bool = False


#: The engines in the order in which they vote.
ENGINES = {
    "tesseract": Engine(1.0, letter="T"),
    "easyocr": Engine(0.9, letter="E"),
    "paddleocr": Engine(0.8, letter="P"),
    "doctr": Engine(1.1, letter="D"),
    "surya": Engine(1.2, iou=0.08, center_distance=50.0, letter="S"),
    "kraken": Engine(1.0, letter="K", enabled=False),
}


@dataclass(frozen=True)
class Config:
    primary: str = "tesseract"
    match: WordMatch = WordMatch()
    engines: dict[str, Engine] = field(default_factory=lambda: dict(ENGINES))
    word_conf: float = 60.0
    low_conf: float = 20.0
    vote_conf: float = 40.0
    solo_conf: float = 92.0
    solo_high_conf: float = 98.0

    @property
    def secondaries(self) -> list[str]:
        return [e for e, s in self.engines.items() if e != self.primary and s.enabled]

    def match_of(self, engine: str) -> WordMatch:
        s, m = self.engines[engine], self.match
        return WordMatch(m.iou if s.iou is None else s.iou, m.text_bonus, m.center_distance if s.center_distance is None else s.center_distance)


def _by_engine(values: dict[str, float], default: float, column: str = "engine") -> Column:
    out = F.lit(default)
    for e, v in values.items():
        out = F.when(F.col(column) == e, v).otherwise(out)
    return out


def candidate_matches(words: DataFrame, config: Config = Config()) -> DataFrame:
    """The pairs of a primary (l_) and a secondary word (r_) that may be one, with their engine and score: one join for all engines, each with its own
    thresholds."""
    primary = words.where(F.col("engine") == config.primary)
    second = words.where(F.col("engine").isin([e for e in config.secondaries if not config.engines[e].lines]))
    of = {e: config.match_of(e) for e in config.secondaries}
    by = lambda f: _by_engine({e: f(m) for e, m in of.items()}, 0.0, "r_engine")
    reach = _by_engine({e: m.band for e, m in of.items()}, 0.0)
    middle = G.center_y()
    p = banded_pairs(primary, second, spans=((middle, middle), (middle - reach, middle + reach))).where(F.abs(G.center_y("l_") - G.center_y("r_")) <= by(lambda m: m.band))
    score = match_score(config.match, by(lambda m: m.iou), by(lambda m: m.center_distance))
    return p.withColumn("score", score).where(F.col("score").isNotNull()).withColumn("file_id", F.col("l_file_id")).withColumn("page", F.col("l_page")).withColumn("engine", F.col("r_engine"))


def line_matches(primary: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, page, engine, l_word_id, r_word_id, text: primary words in order each take the first line of an engine whose box holds their center and that is
    free; the text is the word of the line at the center's relative place. A line goes to one word."""
    middle = G.center_y()
    p = banded_pairs(primary, lines, spans=((middle, middle), span())).where(G.contains("r_", G.center_x("l_"), G.center_y("l_")))
    wide = G.width("r_")
    place = F.when(wide > 0, (G.center_x("l_") - F.col("r_x0")) / wide).otherwise(0.5)
    p = p.select(F.col("l_file_id").alias("file_id"), F.col("l_page").alias("page"), F.col("r_engine").alias("engine"), "l_word_id", "r_word_id", F.col("l_idx").alias("l_ord"), F.col("r_idx").alias("r_ord"), F.lit(0.0).alias("score"), word_at(F.col("r_text"), place).alias("text"))
    group = [*PAGE, "engine"]
    picked = greedy_assign(p, group, "l_ord", "r_ord", "score").drop("score")
    return p.join(picked, [*group, "l_ord", "r_ord"]).select(*group, "l_word_id", "r_word_id", "text")


def match_secondaries(words: DataFrame, config: Config = Config()) -> DataFrame:
    """file_id, page, engine, primary word id (l_word_id), secondary word id (r_word_id), score, text (null but for engines of lines): each engine's
    matches with the primary."""
    pairs = candidate_matches(words, config).select(*PAGE, "engine", "l_word_id", "r_word_id", F.col("l_idx").alias("l_ord"), F.col("r_idx").alias("r_ord"), "score")
    group = [*PAGE, "engine"]
    picked = greedy_assign(pairs, group, "l_ord", "r_ord", "score").drop("score")
    found = pairs.join(picked, [*group, "l_ord", "r_ord"]).select(*group, "l_word_id", "r_word_id", "score", F.lit(None).cast("string").alias("text"))
    of_lines = [e for e in config.secondaries if config.engines[e].lines]
    if not of_lines:
        return found
    lines = line_matches(words.where(F.col("engine") == config.primary), words.where(F.col("engine").isin(of_lines)))
    return found.unionByName(lines.withColumn("score", F.lit(0.0)))


def known_words(words: DataFrame, config: Config = Config()) -> DataFrame:
    """file_id, page, known: lower-case words of three signs and more that an engine was sure of (primary 80, others 90), and their parts."""
    sure = F.col("confidence") >= F.when(F.col("engine") == config.primary, 80).otherwise(90)
    low = F.lower(F.trim("text"))
    parts = F.filter(F.split(low, "[^a-zA-Z]+"), lambda x: F.length(x) >= 3)
    return words.where(sure & (F.length(F.trim("text")) >= 3)).select(*PAGE, F.explode(F.array_union(F.array(low), parts)).alias("known")).distinct()


def likeness(votes: DataFrame, known: DataFrame) -> DataFrame:
    """vote_id, likeness: the greatest similarity of a part of a vote's text with a known word of its page, where above 0.7.

    Only parts whose length can reach that similarity meet: the join is on page, and on length within 30 percent.
    """
    parts = votes.select(*PAGE, "vote_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-zA-Z]+"), lambda x: F.length(x) >= 3)).alias("part")).distinct()
    near = F.abs(F.length("part") - F.length("known")) < 0.3 * F.greatest(F.length("part"), F.length("known"))
    scored = parts.join(known, PAGE).where(near).withColumn("likeness", similarity(F.col("part"), F.col("known"))).where("likeness > 0.7")
    return scored.groupBy("vote_id").agg(F.max("likeness").alias("likeness"))


def votes(words: DataFrame, matches: DataFrame, config: Config = Config()) -> DataFrame:
    """primary_id, engine, text, confidence, weight (without likeness) of every admitted vote: the primary's own and those matched with
    enough confidence; blank texts don't vote."""
    primary = words.where(F.col("engine") == config.primary).select(*PAGE, F.col("word_id").alias("primary_id"), "word_id", "engine", "text", "confidence")
    read = words.select("word_id", F.col("text").alias("_own"), "confidence")
    other = matches.join(read, F.col("r_word_id") == F.col("word_id")).withColumn("text", F.coalesce("text", "_own")).where(F.col("confidence") >= config.vote_conf)
    v = primary.unionByName(other.select(*PAGE, F.col("l_word_id").alias("primary_id"), "word_id", "engine", "text", "confidence")).where(F.trim("text") != "").withColumnRenamed("word_id", "vote_id")
    ballot = Window.partitionBy("primary_id")
    rank = _by_engine({e: float(i) for i, e in enumerate([config.primary, *config.secondaries])}, 99.0).cast("bigint")
    v = v.withColumn("ord", rank).withColumn("_texts", F.collect_list(F.struct("ord", "text")).over(ballot))
    others = F.transform(F.filter("_texts", lambda x: x["ord"] != F.col("ord")), lambda x: x["text"])
    weight = (
        _by_engine({e: s.weight for e, s in config.engines.items()}, 1.0)
        * (0.5 + 0.5 * F.col("confidence") / 100)
        * F.when(garbage(F.col("text")), _by_engine({e: s.garbage_penalty for e, s in config.engines.items()}, 1.0)).otherwise(1.0)
        * F.when(concatenated(F.col("text"), others), 0.1).otherwise(1.0)
    )
    return v.withColumn("weight", weight).drop("_texts")


def elect(ballots: DataFrame) -> DataFrame:
    """primary_id, text, max_confidence, n_votes, source engines: the normalised text with the greatest weight; the first seen wins ties, and its
    first spelling is kept."""
    norm = F.lower(F.trim("text"))
    one = ballots.groupBy("primary_id", norm.alias("norm")).agg(F.sum("weight").alias("w"), F.min(F.struct("ord", "text")).alias("first"), F.max("confidence").alias("c"), F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("ord", "engine")).alias("e"))
    best = F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("first.ord")).alias("o"), F.col("first.text").alias("text")))["text"]
    return one.groupBy("primary_id").agg(best.alias("text"), F.max("c").alias("max_confidence"), F.sum("n").alias("n_votes"), F.transform(F.array_sort(F.flatten(F.collect_list("e"))), lambda x: x["engine"]).alias("engines"))


def source_letters(engines: Column, config: Config = Config()) -> Column:
    letters = F.create_map(*[F.lit(x) for e, s in config.engines.items() for x in (e, s.letter)])
    return F.array_join(F.transform(engines, lambda e: letters[e]), "")


def status_of(confidence: Column, config: Config = Config()) -> Column:
    return F.when(confidence >= config.word_conf, "word").when(confidence >= config.low_conf, "low_conf").otherwise("pixel")


def solo_status(confidence: Column, corroborated: Column, config: Config = Config()) -> Column:
    """Status of a word that the primary has not: trusted alone from a high confidence on, from a lower one if another engine has it too."""
    return F.when((confidence >= config.solo_high_conf) | ((confidence >= config.solo_conf) & corroborated), "secondary_only").when(confidence >= config.low_conf, "low_conf").otherwise("pixel")


def suppressed(words: DataFrame, config: Config = Config()) -> DataFrame:
    """word_id of secondary words of confidence below 50 that hold the centers of two or more primary words."""
    primary = words.where(F.col("engine") == config.primary)
    weak = words.where((F.col("engine") != config.primary) & (F.col("confidence") < 50))
    middle = G.center_y(), G.center_y()
    p = banded_pairs(weak, primary, spans=(span(), middle)).where(G.contains("l_", G.center_x("r_"), G.center_y("r_")))
    return p.groupBy(F.col("l_word_id").alias("word_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("word_id")


def corroborated(words: DataFrame, threshold: float) -> DataFrame:
    """word_id of secondary words that another secondary engine has too, by IoU."""
    p = banded_pairs(words, words).where((F.col("l_engine") != F.col("r_engine")) & (G.iou("l_", "r_") >= threshold))
    return p.select(F.col("l_word_id").alias("word_id")).distinct()


def unmatched_secondaries(words: DataFrame, matches: DataFrame, config: Config = Config()) -> DataFrame:
    """Secondary words that the primary has not, each printed word once.

    Words that overlap a primary box, are suppressed, or repeat the text of a primary word within 15 points vertically fall away by anti-joins; of the rest a word
    is taken, in engine order and position, unless it overlaps or repeats one taken before: a fold over the few that are left of a page.
    """
    primary = words.where(F.col("engine") == config.primary)
    second = words.where(F.col("engine").isin(config.secondaries))
    rest = second.join(matches.select(F.col("r_word_id").alias("word_id")).distinct(), "word_id", "left_anti").join(suppressed(words, config), "word_id", "left_anti")
    near = banded_pairs(rest, primary, 15.0)
    dy = F.abs(G.center_y("l_") - G.center_y("r_"))
    blocked = near.where((G.iou("l_", "r_") >= config.match.iou) | ((compare_key(F.col("l_text")) == compare_key(F.col("r_text"))) & (compare_key(F.col("l_text")) != "") & (dy <= 15))).select(F.col("l_word_id").alias("word_id")).distinct()
    left = rest.join(blocked, "word_id", "left_anti")
    rank = _by_engine({e: float(i) for i, e in enumerate(config.secondaries)}, 99.0).cast("bigint")
    item = F.struct(rank.alias("o"), F.col("idx").alias("i"), "word_id", *BOX, compare_key(F.col("text")).alias("key"))
    kind = "array<struct<o:bigint,i:bigint,word_id:bigint,x0:double,y0:double,x1:double,y1:double,key:string>>"

    def clash(a: Column, b: Column) -> Column:
        w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
        overlap = F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(0.0)
        return (overlap >= config.match.iou) | ((a["key"] == b["key"]) & (a["key"] != "") & (F.abs(a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2 <= 15))

    kept = left.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kind), lambda s, x: F.when(F.exists(s, lambda y: clash(x, y)), s).otherwise(F.array_append(s, x))).alias("k"))
    return left.join(kept.select(F.explode("k.word_id").alias("word_id")), "word_id", "left_semi")


def fragments(rows: DataFrame) -> DataFrame:
    """word_id of fragments: words of one source and low confidence, two or more of which one sure secondary-only word covers on its line."""
    whole = rows.where((F.col("status") == "secondary_only") & (F.col("confidence") >= 90))
    piece = rows.where(F.col("status").isin("low_conf", "pixel") & (F.length("source") == 1))
    p = banded_pairs(whole, piece, 15.0).where((F.abs(G.center_y("l_") - G.center_y("r_")) <= 15) & (F.least("l_x1", "r_x1") > F.greatest("l_x0", "r_x0")))
    n = Window.partitionBy("l_word_id")
    return p.withColumn("n", F.count(F.lit(1)).over(n)).where("n >= 2").select(F.col("r_word_id").alias("word_id")).distinct()


def harmonize(words: DataFrame, config: Config = Config()) -> DataFrame:
    """file_id, page, word_id, box, text, status, source, confidence, position: the harmonised words of every page.

    ``words`` has file_id, page, word_id, engine, idx, text, confidence and a box. Pages without primary words consist of what the
    secondaries have. Rows of engines that are not enabled are ignored. word_id is that of the row the box comes from.
    """
    words = words.where(F.col("engine").isin([config.primary, *config.secondaries]))
    words = cut(words)
    matches = cut(match_secondaries(words, config))
    ballots = votes(words, matches, config).withColumnRenamed("weight", "_w")
    like = likeness(ballots, known_words(words, config))
    boost = F.when((F.coalesce("likeness", F.lit(0.0)) > 0.7) & (F.length("text") > 5), 1 + (F.col("likeness") - 0.7) * 1.67).otherwise(1.0)
    elected = elect(ballots.join(like, "vote_id", "left").withColumn("weight", F.col("_w") * boost))
    primary = words.where(F.col("engine") == config.primary).drop("text", "confidence", "engine", "idx")
    rows = primary.join(elected.withColumnRenamed("primary_id", "word_id"), "word_id", "left").select(
        *PAGE, "word_id", *BOX, F.coalesce("text", F.lit("")).alias("text"), status_of(F.coalesce("max_confidence", F.lit(0.0)), config).alias("status"),
        F.coalesce(source_letters(F.col("engines"), config), F.lit(config.engines[config.primary].letter)).alias("source"), F.coalesce("max_confidence", F.lit(0.0)).alias("confidence"),
    )
    solo = unmatched_secondaries(words, matches, config)
    backed = corroborated(words.where(F.col("engine") != config.primary), config.match.iou).withColumn("_backed", F.lit(True))
    solo = solo.join(backed, "word_id", "left").select(
        *PAGE, "word_id", *BOX, "text", solo_status(F.col("confidence"), F.coalesce("_backed", F.lit(False)), config).alias("status"), source_letters(F.array("engine"), config).alias("source"), "confidence"
    )
    everything = cut(rows.unionByName(solo))
    everything = everything.join(fragments(everything), "word_id", "left_anti")
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "word_id")
    return everything.withColumn("position", F.row_number().over(order).cast("bigint") - 1)

"""Correcting words against dictionaries: exact and fuzzy look-up, four ranking signals, and the phases of a word."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import patterns as P
from leafspan.functions.text import core_of, digit_ratio, like_case, prefix_of, suffix_of
from leafspan.session import cut

#: Signs that are read for each other: (pattern, read for, probability, place of the sign in the word or None).
CONFUSIONS = (
    ("l", "1iI|", 0.9, None), ("1", "liI|", 0.9, None), ("i", "l1I|", 0.85, None), ("I", "l1i|", 0.85, None),
    ("0", "Oo", 0.9, None), ("O", "0o", 0.85, None), ("o", "0O", 0.8, None),
    ("c", "e", 0.6, "end"), ("e", "c", 0.55, "end"), ("a", "o", 0.6, "middle"), ("o", "a", 0.55, "middle"),
    ("h", "n", 0.65, None), ("n", "h", 0.6, None), ("S", "5", 0.7, None), ("5", "S", 0.7, None), ("B", "8", 0.65, None), ("8", "B", 0.65, None),
)
#: Pairs of signs read for another sign or pair.
MULTI = (("rn", "m", 0.85), ("m", "rn", 0.8), ("cl", "d", 0.7), ("d", "cl", 0.6), ("vv", "w", 0.75), ("w", "vv", 0.7), ("ii", "u", 0.7), ("u", "ii", 0.65))


#: Parts into which short texts of one length are divided among tasks.
SALT = 16


@dataclass(frozen=True)
class Weights:
    frequency: float = 1.0
    document: float = 0.3
    bigram: float = 0.5
    ocr: float = 0.4
    fallback_frequency: float = 1.0
    min_occurrences: int = 2


@dataclass(frozen=True)
class Config:
    dictionaries: tuple[str, ...] = ("medical", "custom", "place", "product")
    single_char_conf: float = 50.0
    preserve_conf: float = 100.0
    numeric_ratio: float = 0.5
    correct_edits: int = 2
    correct_score: float = 0.3
    context_edits: int = 3
    context_score: float = 0.2
    weights: Weights = field(default_factory=Weights)


def _rank_of(dictionary: Column, config: Config) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(d) for d in config.dictionaries]), dictionary), F.lit(0)).cast("bigint")


def exact_lookup(cores: DataFrame, terms: DataFrame, config: Config = Config(), core: str = "core") -> DataFrame:
    """``cores`` with exact_dictionary: the first dictionary, in the configured order, that has the word as written, else in lower case; null if none."""
    t = terms.select("dictionary", "term", "term_lower", _rank_of(F.col("dictionary"), config).alias("rank"))
    written = t.groupBy(F.col("term").alias(core)).agg(F.min(F.struct("rank", "dictionary"))["dictionary"].alias("_a"))
    lower = t.groupBy(F.col("term_lower").alias("_low")).agg(F.min(F.struct("rank", "dictionary"))["dictionary"].alias("_b"))
    return cores.join(written, core, "left").withColumn("_low", F.lower(core)).join(lower, "_low", "left").withColumn("exact_dictionary", F.coalesce("_a", "_b")).drop("_a", "_b", "_low")


def _segments(length: Column, k: int) -> list[tuple[Column, Column]]:
    """Start and length of the k + 1 segments that a string of ``length`` is cut into."""
    base, more = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    out = []
    for i in range(k + 1):
        longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(k + 1) - more))
        out.append((F.lit(i) * base + longer, base + F.when(F.lit(i) >= F.lit(k + 1) - more, 1).otherwise(0)))
    return out


def similar_pairs(queries: DataFrame, terms: DataFrame, k: int, query: str = "query", term: str = "term") -> DataFrame:
    """query, term, distance of all pairs within ``k`` edits, each once.

    A term is cut into k + 1 segments, one of which every text within k edits holds unchanged, shifted by at most k. So the pairs meet in an equi-join
    on (length, segment number, segment), exact and without comparing everything with everything. Terms of at most k signs meet texts by both lengths.
    """
    t = terms.select(F.col(term).alias("t")).where("t <> ''").distinct().withColumn("n", F.length("t"))
    key = lambda n, i, s: F.concat_ws("|", n.cast("string"), F.lit(str(i)), s)
    tk = F.array(*[key(F.col("n"), i, F.substr(F.col("t"), s + 1, m)) for i, (s, m) in enumerate(_segments(F.col("n"), k))])
    # texts of k signs and fewer have nothing to share: they meet by their lengths, salted on the side of the queries, which may be many
    blank = lambda n, l, salt: F.concat_ws("|", n.cast("string"), l.cast("string"), salt.cast("string"))
    salts = [F.lit(i) for i in range(SALT)]
    short = F.flatten(F.transform(F.sequence(F.greatest(F.col("n") - k, F.lit(1)), F.col("n") + k), lambda l: F.transform(F.array(*salts), lambda s: blank(F.col("n"), l, s))))
    tk = F.when(F.col("n") <= k, short).otherwise(tk)
    q = queries.select(F.col(query).alias("q")).where("q <> ''").distinct().withColumn("l", F.length("q"))

    def keys_of(n: Column, i: int, start: Column, size: Column) -> Column:
        shifts = F.filter(F.transform(F.array(*[F.lit(d) for d in range(-k, k + 1)]), lambda d: start + d), lambda p: (p >= 0) & (p + size <= F.col("l")))
        return F.transform(shifts, lambda p: key(n, i, F.substr(F.col("q"), p + 1, size)))

    def of_length(n: Column) -> Column:
        return F.concat(*[keys_of(n, i, s, m) for i, (s, m) in enumerate(_segments(n, k))])

    lengths = F.filter(F.sequence(F.col("l") - k, F.col("l") + k), lambda n: n > k)
    qk = F.concat(F.flatten(F.transform(lengths, of_length)), F.when(F.col("l") <= 2 * k, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda n: blank(n, F.col("l"), F.pmod(F.xxhash64("q"), F.lit(SALT))))).otherwise(F.array().cast("array<string>")))
    pairs = q.select("q", F.explode(F.array_distinct(qk)).alias("key")).join(t.select("t", F.explode(F.array_distinct(tk)).alias("key")), "key").select("q", "t").distinct()
    return pairs.withColumn("d", F.levenshtein("q", "t", k)).where("d >= 0").select(F.col("q").alias(query), F.col("t").alias(term), F.col("d").cast("bigint").alias("distance"))


# -- ranking signals -------------------------------------------------------------------------------------------------


def frequency_factor(frequency: Column, greatest: Column, w: Weights = Weights()) -> Column:
    """log10(f + 1) / log10(max + 1) to the power of one over the weight; unknown words have the fallback frequency."""
    return F.pow(F.log10(F.coalesce(frequency.cast("double"), F.lit(w.fallback_frequency)) + 1) / F.log10(greatest + 1), F.lit(1 / w.frequency))


def document_factor(count: Column, w: Weights = Weights()) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n >= w.min_occurrences, 1 + w.document * F.log10(n + 1)).otherwise(1.0)


def bigram_factor(before: Column, n_before: Column, after: Column, n_word: Column, w: Weights = Weights()) -> Column:
    """From the counts of (previous word, word), previous word, (word, next word) and word: the mean of the probabilities there are, on a log scale held to
    0.5 to 2; 1 where there are none."""
    p1 = F.when(before.isNotNull(), F.try_divide(before, n_before))
    p2 = F.when(after.isNotNull(), F.try_divide(after, n_word))
    mean = F.when(p1.isNotNull() & p2.isNotNull(), (p1 + p2) / 2).otherwise(F.coalesce(p1, p2))
    return F.when(mean.isNull() | (mean <= 0), 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1 + w.bigram * F.log10(1e6 * mean + 1) / 10)))


def ocr_factor(original: Column, candidate: Column, w: Weights = Weights()) -> Column:
    """Geometric mean of the factors of the differences that are known confusions: one plus the probability for a sign read for another in place; for
    pairs of signs, where the lengths differ, the probability itself. 1 where none is known."""
    n = F.length(original)
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("p"), F.lit(c).cast("string").alias("c")) for a, b, p, c in CONFUSIONS])
    ends = F.least(n, F.length(candidate))
    places = F.when(ends > 0, F.sequence(F.lit(1), ends)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        o, c = F.substr(original, i, F.lit(1)), F.substr(candidate, i, F.lit(1))
        fits = lambda x: (
            (x["c"].isNull() | ((x["c"] == "end") & (i == n)) | ((x["c"] == "middle") & (i > 1) & (i < n))) & (((x["a"] == o) & F.contains(x["b"], c)) | ((x["a"] == c) & F.contains(x["b"], o)))
        )
        return F.when(o != c, F.get(F.filter(table, fits), F.lit(0))["p"] + 1)

    single = F.filter(F.transform(places, at), lambda x: x.isNotNull())
    multi = F.array(*[F.when((n != F.length(candidate)) & ((F.contains(original, F.lit(a)) & F.contains(candidate, F.lit(b))) | (F.contains(original, F.lit(b)) & F.contains(candidate, F.lit(a)))), F.lit(p)) for a, b, p in MULTI])
    factors = F.concat(single, F.filter(multi, lambda x: x.isNotNull()))
    product = F.aggregate(factors, F.lit(1.0), lambda s, x: s * x)
    return F.when(F.size(factors) > 0, 1 + (F.pow(product, F.lit(1.0) / F.size(factors)) - 1) * w.ocr).otherwise(1.0)


def unigrams(words: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each lower-case core occurs."""
    return words.select(F.lower(core_of(F.col(text))).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def neighbours(words: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """``words`` with before and after: the lower-case cores of the words on either side, over the whole of a document.

    ``by`` is the document and the page. Words are put in order page by page; the first and the last word of a page look over the break
    through one small row per page, so that no document is sorted in one task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    core = F.lower(core_of(F.col(text)))
    edge = F.struct(*order, core.alias("_core"))
    over = Window.partitionBy(*by[:-1]).orderBy(by[-1])
    ends = words.groupBy(*by).agg(F.min(edge)["_core"].alias("_first"), F.max(edge)["_core"].alias("_last"))
    ends = ends.select(*by, F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    side = lambda c, page: F.when(c.isNotNull(), c["c"]).otherwise(F.col(page))
    one = F.struct(core.alias("c"))
    n = words.withColumn("_b", F.lag(one).over(w)).withColumn("_a", F.lead(one).over(w)).join(ends, by)
    return n.withColumn("before", side(F.col("_b"), "_before")).withColumn("after", side(F.col("_a"), "_after")).drop("_b", "_a", "_before", "_after")


def context_window(words: DataFrame, by: list[str], order: list[str], width: int, text: str = "text") -> DataFrame:
    """``words`` with context: the lower-case texts of up to ``width`` words on either side within ``by``, without the word itself."""
    w = Window.partitionBy(*by).orderBy(*order)
    sides = [F.collect_list(F.lower(text)).over(w.rowsBetween(*r)) for r in ((-width, -1), (1, width))]
    return words.withColumn("context", F.concat(*sides))


def side_totals(two: DataFrame) -> DataFrame:
    """word, n: the counts of pairs of words (w1, w2, n), summed over both sides."""
    return two.select(F.explode(F.array("w1", "w2")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(words: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """w1, w2, n of words that stand side by side."""
    n = neighbours(words, by, order, text).select(F.lower(core_of(F.col(text))).alias("w1"), F.col("after").alias("w2")).where("w1 <> '' and w2 <> ''")
    return n.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


# -- phases ----------------------------------------------------------------------------------------------------------


def skip_reason(text: Column, confidence: Column, engine: Column, config: Config = Config()) -> Column:
    return F.when(F.coalesce(engine, F.lit("")) == "pixel_detector", "pixel").when((F.length(text) == 1) & (confidence < config.single_char_conf), "single")


def preserve_reason(text: Column, confidence: Column, exact: Column, exact_core: Column, config: Config = Config()) -> Column:
    return (
        F.when(confidence >= config.preserve_conf, "confidence")
        .when(digit_ratio(text) >= config.numeric_ratio, "numeric")
        .when(text.contains("@"), "email")
        .when(P.matches(text, P.DATES), "date")
        .when(exact.isNotNull(), "dictionary")
        .when(exact_core.isNotNull(), "dictionary_core")
    )


def sanitize(words: DataFrame, terms: DataFrame, config: Config = Config(), ranked: bool = True, keep_uncertain: bool = True) -> DataFrame:
    """``words`` (file_id, page, word_id, text, confidence, engine) with status, sanitized_text, edit_distance, correction_score and matched_dictionary;
    columns that had these names are replaced.

    The phases in order: skip, preserve, correct (two edits), context (three), uncertain (kept, or left blank without ``keep_uncertain``). Candidates are looked up once for each distinct core; the factors
    that depend on the place (document, bigram) are joined to the candidates of the words that reach these phases. Of equal scores the smaller distance
    wins, then the earlier dictionary, then the term that stands first in it (``ord``, where ``terms`` has it, else in the order of terms).
    """
    order = ["file_id", "page"]
    w = words.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("core", core_of(F.col("text")))
    whole = exact_lookup(w.select("text").distinct(), terms, config, "text").withColumnRenamed("exact_dictionary", "_whole")
    bare = exact_lookup(w.select("core").distinct(), terms, config, "core").withColumnRenamed("exact_dictionary", "_core")
    w = neighbours(w, order, ["word_id"]).join(whole, "text").join(bare, "core")
    w = w.withColumn("_skip", skip_reason(F.col("text"), F.col("confidence"), F.col("engine"), config)).withColumn("_keep", preserve_reason(F.col("text"), F.col("confidence"), F.col("_whole"), F.col("_core"), config))
    w = cut(w)
    open_ = w.where("_skip is null and _keep is null and core <> ''")
    pairs = similar_pairs(open_.select(F.lower("core").alias("query")), terms, config.context_edits, "query", "term_lower")
    place = F.col("ord").cast("bigint") if "ord" in terms.columns else F.lit(0).cast("bigint")
    entries = terms.select("term_lower", "term", "dictionary", "weight", _rank_of(F.col("dictionary"), config).alias("rank"), place.alias("place"))
    cand = open_.select("word_id", "file_id", "core", "before", "after", F.lower("core").alias("query")).join(pairs, "query").join(entries, "term_lower")
    factor = F.lit(1.0)
    if ranked:
        uni = unigrams(w)
        top = uni.agg(F.max("n").cast("double").alias("n")).scalar()
        in_file = w.select("file_id", F.lower("core").alias("word")).groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("n_file"))
        two = bigrams(w, order, ["word_id"])
        cand = (
            cand.join(uni.select(F.col("word").alias("term_lower"), F.col("n").alias("n_term")), "term_lower", "left")
            .join(in_file.select("file_id", F.col("word").alias("term_lower"), "n_file"), ["file_id", "term_lower"], "left")
            .join(two.select(F.col("w1").alias("before"), F.col("w2").alias("term_lower"), F.col("n").alias("n_before_term")), ["before", "term_lower"], "left")
            .join(uni.select(F.col("word").alias("before"), F.col("n").alias("n_before")), "before", "left")
            .join(two.select(F.col("w1").alias("term_lower"), F.col("w2").alias("after"), F.col("n").alias("n_term_after")), ["term_lower", "after"], "left")
        )
        factor = frequency_factor(F.col("n_term"), top, config.weights) * document_factor(F.col("n_file"), config.weights) * bigram_factor(F.col("n_before_term"), F.col("n_before"), F.col("n_term_after"), F.col("n_term"), config.weights) * ocr_factor(F.col("core"), F.col("term"), config.weights)
    score = lambda k: F.round(F.col("weight") * (1 - F.col("distance") / (k + 1)) * factor, 9)
    cand = cand.withColumn("s2", F.when(F.col("distance") <= config.correct_edits, score(config.correct_edits))).withColumn("s3", F.when(F.col("distance") > 0, score(config.context_edits)))
    best = lambda s: F.min(F.when(F.col(s).isNotNull(), F.struct((-F.col(s)).alias("loss"), F.col("distance").alias("d"), F.col("rank").alias("r"), "place", "term", "dictionary")))
    found = cand.groupBy("word_id").agg(best("s2").alias("a"), best("s3").alias("b"))
    r = w.join(found, "word_id", "left")
    corrected, context = F.coalesce(-F.col("a.loss") >= config.correct_score, F.lit(False)), F.coalesce(-F.col("b.loss") >= config.context_score, F.lit(False))
    made = lambda c: F.concat(prefix_of(F.col("text")), like_case(F.col(f"{c}.term"), F.col("core")), suffix_of(F.col("text")))
    pick = lambda skip, keep, a, b, other: F.when(F.col("_skip").isNotNull(), skip).when(F.col("_keep").isNotNull(), keep).when(corrected, a).when(context, b).otherwise(other)
    made_here = ("status", "sanitized_text", "edit_distance", "correction_score", "matched_dictionary")
    return r.select(
        *[c for c in words.columns if c not in made_here],
        pick(F.lit("skipped"), F.lit("preserved"), F.when(F.col("a.d") == 0, "preserved").otherwise("corrected"), F.lit("context"), F.lit("uncertain")).alias("status"),
        pick(F.col("text"), F.col("text"), made("a"), made("b"), F.col("text") if keep_uncertain else F.lit("")).alias("sanitized_text"),
        pick(F.lit(0), F.lit(0), F.col("a.d"), F.col("b.d"), F.lit(0)).cast("bigint").alias("edit_distance"),
        pick(F.lit(0.0), F.lit(1.0), -F.col("a.loss"), -F.col("b.loss"), F.lit(0.0)).alias("correction_score"),
        pick(F.lit(None).cast("string"), F.coalesce("_whole", "_core"), F.col("a.dictionary"), F.col("b.dictionary"), F.lit(None).cast("string")).alias("matched_dictionary"),
    )


def sanitize_evaluation(results: DataFrame, original: str = "original_text", sanitized: str = "sanitized_text", truth: str = "truth", by: list[str] = []) -> DataFrame:
    """One row, or one for each value of ``by``: tp (changed to the truth), fp (changed, but not to it), fn (wrong and left), tn (right and left), precision,
    recall, f1 and accuracy, 0 where nothing is there."""
    o, s, t = (F.coalesce(c, F.lit("")) for c in (original, sanitized, truth))
    count = {"tp": (s != o) & (s == t), "fp": (s != o) & (s != t), "fn": (s == o) & (o != t), "tn": (s == o) & (o == t)}
    r = results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in count.items()])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    r = r.withColumn("p", ratio(c("tp"), c("tp") + c("fp"))).withColumn("r", ratio(c("tp"), c("tp") + c("fn")))
    return r.select(*by, "total", *count, F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(ratio(2 * c("p") * c("r"), c("p") + c("r")), 6).alias("f1"), F.round(ratio(c("tp") + c("tn"), c("total")), 6).alias("accuracy"))


def ranking_factors(words: DataFrame, terms: DataFrame, k: int = 2, config: Config = Config()) -> DataFrame:
    """query, term, distance, frequency, ocr, product: candidates of every distinct lower-case core with the factors that depend on no place, and their product."""
    w = config.weights
    uni = unigrams(words)
    top = uni.agg(F.max("n").cast("double").alias("n")).scalar()
    pairs = similar_pairs(uni.select(F.col("word").alias("query")), terms, k, "query", "term_lower")
    f = pairs.join(uni.select(F.col("word").alias("term_lower"), "n"), "term_lower", "left").withColumn("frequency", frequency_factor(F.col("n"), top, w)).withColumn("ocr", ocr_factor(F.col("query"), F.col("term_lower"), w))
    return f.select("query", "term_lower", "distance", F.round("frequency", 6).alias("frequency"), F.round("ocr", 6).alias("ocr"), F.round(F.col("frequency") * F.col("ocr"), 6).alias("product"))


def sanitize_metrics(results: DataFrame) -> DataFrame:
    """One row of counts by status, and the coverage: the share of words kept or corrected."""
    of = lambda s: F.count_if(F.col("status") == s)
    good = of("preserved") + of("corrected") + of("context")
    return results.agg(F.count(F.lit(1)).alias("total"), *[of(s).alias(s) for s in ("skipped", "preserved", "corrected", "context", "uncertain")], F.round(F.coalesce(F.try_divide(good, F.count(F.lit(1))), F.lit(0.0)), 6).alias("coverage"))

"""Queries on pages of words: matching, harmonising, sanitising, layout, fusion, evaluation, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafspan.functions import geometry as G
from leafspan.functions import text as X
from leafspan.operators import entities as E
from leafspan.operators import fusion as V
from leafspan.operators import harmonize as H
from leafspan.operators import layout as L
from leafspan.operators import matching as M
from leafspan.operators import sanitize as S
from leafspan.session import cut, shared_folder
from leafspan.plans import sql as Q
from leafspan.plans import words as W
from leafspan.plans.base import BOX, EDGE, EW, HW, SW, core, engine_rows, harmonized_rows, slim_rows
from leafspan.sources import table
from leafspan.streaming.words import tagged_stream

PAGE = M.PAGE
r6 = lambda c, name: F.round(c, 6).alias(name)
big = lambda c, name: c.cast("bigint").alias(name)


def _located(spark, d):
    """Harmonised words that have text, as layout and fusion take them."""
    return harmonized_rows(spark, d).where("text <> ''").select(*PAGE, "word_id", "text", *BOX, F.col("conf").alias("confidence"))


# -- matching and harmonising ----------------------------------------------------------------------------------------


def match_candidates(spark, d):
    p = H.candidate_matches(engine_rows(spark, d))
    return p.select(F.col("l_word_id").alias("a"), F.col("r_word_id").alias("b"), "engine", r6(F.col("score"), "score"))


_OF = lambda f: "CASE r.engine " + " ".join(f"WHEN '{e}' THEN {f(*v)}" for e, v in Q.MATCHED.items()) + " END"
_CAND = f"""WITH {EW}, p AS (SELECT l.word_id AS a, r.word_id AS b, r.engine, {Q.iou()} AS iou, {_OF(lambda iou, far: iou)} AS least_iou, {_OF(lambda iou, far: far)} AS most, lower(trim(l.text)) = lower(trim(r.text)) AS same,
  sqrt(pow((l.x0 + l.x1) / 2 - (r.x0 + r.x1) / 2, 2) + pow((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2, 2)) AS far,
  r.confidence >= 90 AND l.confidence <= 30 AND (((r.x0 + r.x1) / 2 BETWEEN l.x0 AND l.x1 AND (r.y0 + r.y1) / 2 BETWEEN l.y0 AND l.y1) OR ((l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1)) AS rescued
  FROM ew l JOIN ew r ON {Q.ON_PAGE} AND l.engine = 'tesseract' AND {Q.DY} <= {_OF(lambda iou, far: max(10, far / 2))}),
t AS (SELECT *, iou + CASE WHEN same THEN 0.5 ELSE 0 END + CASE WHEN rescued THEN 0.3 ELSE 0 END AS score FROM p)
SELECT a, b, engine, round(score, 6) AS score FROM t WHERE score > 0 AND (iou >= CASE WHEN same THEN least_iou - 0.15 ELSE least_iou END OR (same AND far <= most) OR rescued)"""


def match_engine_words(spark, d):
    return H.match_secondaries(engine_rows(spark, d)).select("engine", "l_word_id", "r_word_id", r6(F.col("score"), "score"))


def line_match(spark, d):
    """The lines of every secondary engine's words, and the primary words that each gives a word to."""
    w = engine_rows(spark, d)
    second = w.where("engine <> 'tesseract'")
    lines = None
    for e in H.Config().secondaries:
        one = L.reconstruct_lines(second.where(F.col("engine") == e), "idx").withColumn("engine", F.lit(e))
        lines = one if lines is None else lines.unionByName(one)
    lines = lines.select(*PAGE, "engine", F.col("line").alias("word_id"), F.col("line").alias("idx"), "text", *BOX)
    return H.line_matches(w.where("engine = 'tesseract'"), lines).select("engine", "l_word_id", F.col("r_word_id").alias("line"), "text")


def known_words(spark, d):
    return H.known_words(engine_rows(spark, d))


_KNOWN = f"""WITH {EW}, s AS (SELECT file_id, page, lower(trim(text)) AS t FROM ew WHERE length(trim(text)) >= 3 AND confidence >= CASE engine WHEN 'tesseract' THEN 80 ELSE 90 END)
SELECT file_id, page, t AS known FROM s UNION SELECT file_id, page, p FROM (SELECT file_id, page, unnest(string_split_regex(t, '[^a-zA-Z]+')) AS p FROM s) WHERE length(p) >= 3"""


def _ballots(spark, d):
    """The readings of every harmonised word as votes of equal confidence."""
    names = {"tess": "tesseract", "easy": "easyocr", "paddle": "paddleocr", "doctr": "doctr", "surya": "surya"}
    read = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(e).alias("engine"), F.col(f"{c}_text").alias("text"), F.lit(H.ENGINES[e].weight).alias("base")) for i, (c, e) in enumerate(names.items())])
    v = harmonized_rows(spark, d).select(F.col("word_id").alias("primary_id"), F.col("conf").alias("confidence"), F.explode(read).alias("r")).select("primary_id", "confidence", "r.*").where("trim(text) <> ''")
    return v.withColumn("weight", F.col("base") * (0.5 + 0.5 * F.col("confidence") / 100))


def weighted_vote(spark, d):
    e = H.elect(_ballots(spark, d))
    return e.select("primary_id", "text", "max_confidence", "n_votes", H.source_letters(F.col("engines")).alias("source"))


_VOTE = f"""WITH {HW}, v AS (SELECT word_id AS primary_id, conf, unnest([{{'o': 0, 'l': 'T', 't': tess_text, 'b': 1.0::double}}, {{'o': 1, 'l': 'E', 't': easy_text, 'b': 0.9::double}}, {{'o': 2, 'l': 'P', 't': paddle_text, 'b': 0.8::double}}, {{'o': 3, 'l': 'D', 't': doctr_text, 'b': 1.1::double}}, {{'o': 4, 'l': 'S', 't': surya_text, 'b': 1.2::double}}]) AS r FROM hw),
w AS (SELECT primary_id, conf, r.o AS o, r.l AS l, r.t AS t, r.b * (0.5::double + 0.5::double * conf / 100) AS w FROM v WHERE trim(r.t) <> ''),
g AS (SELECT primary_id, lower(trim(t)) AS norm, round(sum(w), 9) AS s, min(o) AS first, arg_min(t, o) AS text FROM w GROUP BY 1, 2), best AS (SELECT primary_id, text FROM g QUALIFY row_number() OVER (PARTITION BY primary_id ORDER BY s DESC, first) = 1)
SELECT primary_id, best.text, max(conf) AS max_confidence, count(*) AS n_votes, string_agg(l, '' ORDER BY o) AS source FROM w JOIN best USING (primary_id) GROUP BY primary_id, best.text"""


def vote_weights(spark, d):
    """Admitted votes of the matched engine words, with their weights and likeness to known words."""
    w = engine_rows(spark, d)
    b = H.votes(w, H.match_secondaries(w))
    return b.join(H.likeness(b, H.known_words(w)), "vote_id", "left").select("primary_id", "engine", "text", r6(F.col("weight"), "weight"), r6(F.coalesce("likeness", F.lit(0.0)), "likeness"))


def suppressed_words(spark, d):
    """Engine words with an unsure line box around every two neighbours of the primary engine besides, of which those of odd words are unsure."""
    w = engine_rows(spark, d)
    o = Window.partitionBy(*PAGE).orderBy("word_id")
    over = lambda f, c: f(F.col(c), F.lead(c).over(o)).alias(c)
    line = w.where("engine = 'tesseract'").select(*PAGE, (-F.col("word_id")).alias("word_id"), F.lit("easyocr").alias("engine"), "idx", "text", *[over(F.least if c[1] == "0" else F.greatest, c) for c in BOX], F.when(F.col("word_id") % 2 == 1, 30.0).otherwise(80.0).alias("confidence"))
    return H.suppressed(w.unionByName(line.select(w.columns)))


def corroborated_words(spark, d):
    return H.corroborated(engine_rows(spark, d), 0.3)


_BACKED = f"""WITH {EW} SELECT DISTINCT l.word_id FROM ew l JOIN ew r ON {Q.ON_PAGE} AND l.engine <> r.engine AND {Q.iou()} >= 0.3"""
_SUPPRESSED = f"""WITH {EW}, ln AS (SELECT file_id, page, -word_id AS word_id, 'easyocr' AS engine, {', '.join(f"{'least' if c[1] == '0' else 'greatest'}({c}, lead({c}) OVER o) AS {c}" for c in BOX)}, CASE WHEN word_id % 2 = 1 THEN 30 ELSE 80 END AS confidence
  FROM ew WHERE engine = 'tesseract' WINDOW o AS (PARTITION BY file_id, page ORDER BY word_id)), al AS (SELECT file_id, page, word_id, engine, {', '.join(BOX)}, confidence FROM ew UNION ALL SELECT * FROM ln)
SELECT l.word_id FROM al l JOIN al r ON {Q.ON_PAGE} AND l.engine <> 'tesseract' AND r.engine = 'tesseract' AND l.confidence < 50 AND (r.x0 + r.x1) / 2 BETWEEN l.x0 AND l.x1 AND (r.y0 + r.y1) / 2 BETWEEN l.y0 AND l.y1 GROUP BY l.word_id HAVING count(*) >= 2"""


def duplicate_pairs(spark, d):
    w = engine_rows(spark, d)
    p = M.banded_pairs(w, w, 20.0).where(F.col("l_engine") < F.col("r_engine"))
    return p.where(M.duplicates()).select(F.col("l_word_id").alias("a"), F.col("r_word_id").alias("b"))


_DUP = f"""WITH {EW} SELECT l.word_id AS a, r.word_id AS b FROM ew l JOIN ew r ON {Q.ON_PAGE} AND l.engine < r.engine
WHERE {Q.iou()} >= 0.5 OR (lower(trim(l.text)) = lower(trim(r.text)) AND sqrt(pow((l.x0 + l.x1 - r.x0 - r.x1) / 2, 2) + pow((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2, 2)) < 20)"""


def fragment_words(spark, d):
    """Harmonised words, with every sure word also as one that only a secondary engine has, cut into two unsure halves of the primary."""
    w = harmonized_rows(spark, d).withColumnRenamed("conf", "confidence").select(*PAGE, "word_id", "status", "source", "confidence", *BOX)
    sure = w.where("status = 'word' and confidence >= 90")
    mid = (F.col("x0") + F.col("x1")) / 2
    half = lambda n, a, b: sure.select(*PAGE, (-2 * F.col("word_id") - n).alias("word_id"), F.lit("low_conf").alias("status"), F.lit("T").alias("source"), F.lit(30.0).alias("confidence"), a.alias("x0"), "y0", b.alias("x1"), "y1")
    return H.fragments(w.unionByName(sure.withColumn("status", F.lit("secondary_only"))).unionByName(half(0, F.col("x0"), mid)).unionByName(half(1, mid, F.col("x1"))))


_FRAG = f"""WITH {HW}, b AS (SELECT file_id, page, word_id, status, source, conf, x0, y0, x1, y1 FROM hw), s AS (SELECT * FROM b WHERE status = 'word' AND conf >= 90),
a AS (SELECT * FROM b UNION ALL SELECT * REPLACE ('secondary_only' AS status) FROM s UNION ALL SELECT file_id, page, -2 * word_id, 'low_conf', 'T', 30, x0, y0, (x0 + x1) / 2, y1 FROM s UNION ALL SELECT file_id, page, -2 * word_id - 1, 'low_conf', 'T', 30, (x0 + x1) / 2, y0, x1, y1 FROM s),
p AS (SELECT l.word_id AS whole, r.word_id AS word_id FROM a l JOIN a r ON {Q.ON_PAGE} AND l.status = 'secondary_only' AND l.conf >= 90 AND r.status IN ('low_conf', 'pixel') AND length(r.source) = 1 AND {Q.DY} <= 15 AND least(l.x1, r.x1) > greatest(l.x0, r.x0))
SELECT DISTINCT word_id FROM p QUALIFY count(*) OVER (PARTITION BY whole) >= 2"""


def unmatched_secondary(spark, d):
    w = engine_rows(spark, d)
    return H.unmatched_secondaries(w, H.match_secondaries(w)).select("word_id", "engine", "text")


def harmonize_full(spark, d):
    return H.harmonize(engine_rows(spark, d)).select(*PAGE, "word_id", "text", "status", "source", r6(F.col("confidence"), "confidence"), "position")


def harmonize_two_engines(spark, d):
    """The preset of two engines: no rescue by containment, easyocr alone beside the primary."""
    two = {e: s for e, s in H.ENGINES.items() if e in ("tesseract", "doctr")}
    c = H.Config(engines=two, match=M.WordMatch(iou=0.3, rescue=False), solo_conf=0.0, solo_high_conf=0.0)
    return H.harmonize(engine_rows(spark, d).where(F.col("engine").isin(list(two))), c).select("word_id", "text", "status", "source", "position")


# -- sanitising ------------------------------------------------------------------------------------------------------


def _entries(spark, d):
    return table(spark, d, "dict_terms")


def dict_exact(spark, d):
    cores = slim_rows(spark, d).select(X.core_of(F.col("text")).alias("core")).where("core <> ''").distinct()
    return S.exact_lookup(cores, _entries(spark, d))


_RANK = "CASE {0} WHEN 'medical' THEN 1 WHEN 'custom' THEN 2 WHEN 'place' THEN 3 WHEN 'product' THEN 4 ELSE 0 END"
_EXACT = f"""WITH {SW}, c AS (SELECT DISTINCT {core('text')} AS core FROM sw WHERE {core('text')} <> ''), a AS (SELECT term, arg_min(dictionary, {_RANK.format('dictionary')}) AS dictionary FROM dict_terms GROUP BY term), b AS (SELECT term_lower, arg_min(dictionary, {_RANK.format('dictionary')}) AS dictionary FROM dict_terms GROUP BY term_lower)
SELECT core, coalesce(a.dictionary, b.dictionary) AS exact_dictionary FROM c LEFT JOIN a ON c.core = a.term LEFT JOIN b ON lower(c.core) = b.term_lower"""


def dict_fuzzy(spark, d):
    cores = slim_rows(spark, d).select(F.lower(X.core_of(F.col("text"))).alias("query")).where("query <> ''").distinct()
    return S.similar_pairs(cores, _entries(spark, d), 2, "query", "term_lower")


def sanitize_skip_preserve(spark, d):
    w = slim_rows(spark, d).withColumn("core", X.core_of(F.col("text")))
    e = _entries(spark, d)
    w = w.join(S.exact_lookup(w.select("text").distinct(), e, core="text").withColumnRenamed("exact_dictionary", "a"), "text").join(S.exact_lookup(w.select("core").distinct(), e).withColumnRenamed("exact_dictionary", "b"), "core")
    return w.select("word_id", S.skip_reason(F.col("text"), F.col("confidence"), F.col("engine")).alias("skip"), S.preserve_reason(F.col("text"), F.col("confidence"), F.col("a"), F.col("b")).alias("preserve"))


_PRESERVE = f"""WITH {SW}, t AS (SELECT DISTINCT term AS t FROM dict_terms), l AS (SELECT DISTINCT term_lower AS l FROM dict_terms), w AS (SELECT *, {core('text')} AS core FROM sw)
SELECT word_id, CASE WHEN engine = 'pixel_detector' THEN 'pixel' WHEN length(text) = 1 AND confidence < 50 THEN 'single' END AS skip,
  CASE WHEN confidence >= 100 THEN 'confidence' WHEN length(text) > 0 AND length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) >= 0.5 THEN 'numeric' WHEN contains(text, '@') THEN 'email'
  WHEN regexp_matches(text, '^\\d{{1,2}}[/\\-]\\d{{1,2}}[/\\-]\\d{{2,4}}[,.]?$') OR regexp_matches(text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'date'
  WHEN text IN (SELECT t FROM t) OR lower(text) IN (SELECT l FROM l) THEN 'dictionary' WHEN core IN (SELECT t FROM t) OR lower(core) IN (SELECT l FROM l) THEN 'dictionary_core' END AS preserve FROM w"""


def sanitize_full(spark, d):
    return S.sanitize(slim_rows(spark, d), _entries(spark, d)).select("word_id", "status", "sanitized_text", "edit_distance", "correction_score", "matched_dictionary")


def sanitize_unranked(spark, d):
    return S.sanitize(slim_rows(spark, d), _entries(spark, d), ranked=False).select("word_id", "status", "sanitized_text", "edit_distance", r6(F.col("correction_score"), "correction_score"))


def sanitize_metrics(spark, d):
    return S.sanitize_metrics(table(spark, d, "sanitize_results").drop("loaded_at").distinct())


def rank_frequency(spark, d):
    u = S.unigrams(slim_rows(spark, d))
    return u.select("word", r6(S.frequency_factor(F.col("n"), u.agg(F.max("n").cast("double").alias("m")).scalar()), "factor"))


def rank_document(spark, d):
    w = slim_rows(spark, d).select("file_id", F.lower(X.core_of(F.col("text"))).alias("word")).where("word <> ''")
    return w.groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("n")).select("file_id", "word", r6(S.document_factor(F.col("n")), "factor"))


def rank_bigram(spark, d):
    """The factor of every word between its neighbours, from the counts of both pairs."""
    w = S.neighbours(slim_rows(spark, d).withColumn("core", F.lower(X.core_of(F.col("text")))), PAGE, ["word_id"]).where("core <> ''")
    two, one = S.bigrams(slim_rows(spark, d), PAGE, ["word_id"]), S.unigrams(slim_rows(spark, d))
    w = w.select("word_id", "core", "before", "after").join(two.select(F.col("w1").alias("before"), F.col("w2").alias("core"), F.col("n").alias("nb")), ["before", "core"], "left")
    w = w.join(one.select(F.col("word").alias("before"), F.col("n").alias("n1")), "before", "left").join(two.select(F.col("w1").alias("core"), F.col("w2").alias("after"), F.col("n").alias("na")), ["core", "after"], "left").join(one.select(F.col("word").alias("core"), F.col("n").alias("n2")), "core", "left")
    return w.select("word_id", r6(S.bigram_factor(F.col("nb"), F.col("n1"), F.col("na"), F.col("n2")), "factor"))


_READINGS = {"tess": "tesseract", "easy": "easyocr", "doctr": "doctr", "paddle": "paddleocr", "surya": "surya"}


def _readings(spark, d):
    """word_id, text, engine, reading of every engine that read a word at all."""
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.col(f"{c}_text").alias("reading")) for c, e in _READINGS.items()])).alias("r")
    return harmonized_rows(spark, d).select("word_id", "text", each).select("word_id", "text", "r.*").where("reading <> ''")


_READ = "rd AS (" + " UNION ALL ".join(f"SELECT word_id, text, '{e}' AS engine, {c}_text AS reading FROM hw WHERE {c}_text <> ''" for c, e in _READINGS.items()) + ")"


def case_transfer(spark, d):
    """Every voted text in the case of each engine's reading."""
    return _readings(spark, d).select("word_id", "engine", X.like_case(X.normalised(F.col("text")), F.col("reading")).alias("cased"))


def rank_ocr_model(spark, d):
    """How likely each engine's reading is a misreading of the voted text."""
    w = _readings(spark, d).where("reading <> text")
    return w.select("word_id", "engine", r6(S.ocr_factor(F.col("reading"), F.col("text")), "factor"))


def _ocr_sql() -> str:
    """Places where two texts differ by a known confusion, and known pairs of signs where the lengths differ."""
    single = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {p}::double AS p, {'NULL' if c is None else repr(c)} AS c, {i} AS k" for i, (a, b, p, c) in enumerate(S.CONFUSIONS))
    multi = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {p}::double AS p" for a, b, p in S.MULTI)
    return f"""WITH {HW}, {_READ}, t AS (SELECT DISTINCT reading AS o, text AS c FROM rd WHERE reading <> text), si AS ({single}), mu AS ({multi}),
pl AS (SELECT o, c, unnest(range(1, least(length(o), length(c)) + 1)) AS i FROM t),
hit AS (SELECT pl.o, pl.c, i, arg_min(p, k) + 1 AS f FROM pl JOIN si ON substr(pl.o, i, 1) <> substr(pl.c, i, 1) AND (si.c IS NULL OR (si.c = 'end' AND i = length(pl.o)) OR (si.c = 'middle' AND i > 1 AND i < length(pl.o)))
  AND ((si.a = substr(pl.o, i, 1) AND contains(si.b, substr(pl.c, i, 1))) OR (si.a = substr(pl.c, i, 1) AND contains(si.b, substr(pl.o, i, 1)))) GROUP BY pl.o, pl.c, i),
al AS (SELECT o, c, f FROM hit UNION ALL SELECT o, c, p FROM t JOIN mu ON length(o) <> length(c) AND ((contains(o, a) AND contains(c, b)) OR (contains(o, b) AND contains(c, a)))),
fa AS (SELECT o, c, pow(product(f), 1.0 / count(*)) AS m FROM al GROUP BY o, c)
SELECT word_id, engine, round(CASE WHEN m IS NULL THEN 1 ELSE 1 + (m - 1) * {S.Weights().ocr} END, 6) AS factor FROM rd LEFT JOIN fa ON rd.reading = fa.o AND rd.text = fa.c WHERE reading <> text"""


def bigram_totals(spark, d):
    """How often every word stands in a pair of neighbours, on either side."""
    return S.side_totals(S.bigrams(slim_rows(spark, d), PAGE, ["word_id"]))


def context_windows(spark, d):
    """The three words on either side of every word, without itself."""
    return S.context_window(slim_rows(spark, d), PAGE, ["word_id"], 3).select("word_id", F.array_join("context", " ").alias("context"))


_CORES = f"{SW}, c AS (SELECT file_id, page, word_id, text, lower({core('text')}) AS w FROM sw)"
_TWO = f"{_CORES}, u AS (SELECT w, count(*) AS n FROM c WHERE w <> '' GROUP BY w), b AS (SELECT word_id, w, lag(w) OVER o AS wb, lead(w) OVER o AS wa FROM c WINDOW o AS (PARTITION BY file_id ORDER BY page, word_id)), k AS (SELECT w AS w1, wa AS w2, count(*) AS n FROM b WHERE w <> '' AND wa <> '' GROUP BY 1, 2)"


# -- layout ----------------------------------------------------------------------------------------------------------


def distance_thresholds(spark, d):
    return L.distance_thresholds(_located(spark, d)).select(*PAGE, r6(F.col("x_threshold"), "x_threshold"), r6(F.col("y_threshold"), "y_threshold"))


def y_fuzz(spark, d):
    return L.y_fuzz(_located(spark, d)).select(*PAGE, F.round("fuzz", 12).alias("fuzz"))


def text_rows(spark, d):
    w = _located(spark, d)
    return L.rows(w, L.y_fuzz(w)).select("word_id", big(F.col("row"), "row"))


def column_boundaries(spark, d):
    return L.column_boundaries(_located(spark, d)).select(*PAGE, big(F.size("bounds"), "n"), r6(F.coalesce(F.array_min("bounds"), F.lit(0.0)), "first"), r6(F.coalesce(F.array_max("bounds"), F.lit(0.0)), "last"))


def assigned_columns(spark, d):
    w = _located(spark, d)
    return L.with_columns_of(w, L.column_boundaries(w)).select("word_id", "col")


def cluster_edges(spark, d):
    return L.cluster_edges(_located(spark, d)).groupBy(*PAGE, "rule").agg(F.count(F.lit(1)).alias("edges"))


def clusters(spark, d):
    return L.clusters(_located(spark, d)).select("word_id", "cluster", *[r6(F.col(f"c_{b}"), f"c_{b}") for b in BOX])


def reading_order(spark, d):
    return L.reading_order(_located(spark, d)).select("word_id", "cluster", "band", "row", "position")


def reading_order_compact(spark, d):
    return L.reading_order(_located(spark, d), L.COMPACT).select("word_id", "cluster", "band", "row", "position")


def cluster_outliers(spark, d):
    return L.cluster_outliers(L.clusters(_located(spark, d))).select("word_id", "cluster", "front")


def reconstruct_lines(spark, d):
    return L.reconstruct_lines(_located(spark, d)).select(*PAGE, "line", "text", "n_words", *[r6(F.col(b), b) for b in BOX])


def order_concordance(spark, d):
    return L.order_concordance(L.reading_order(_located(spark, d))).select(*PAGE, r6(F.col("concordance"), "concordance"))


# -- fusion ----------------------------------------------------------------------------------------------------------


def _vlm(spark, d):
    """One engine's readings as the free text of a page."""
    w = harmonized_rows(spark, d).where("doctr_text <> ''")
    return w.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "doctr_text"))), lambda x: x["doctr_text"]), " ").alias("vlm_text"))


def context_signatures(spark, d):
    return V.context_signatures(_located(spark, d), "text", "word_id", 2).select("word_id", "context")


def char_sizes(spark, d):
    return V.char_sizes(_located(spark, d)).select(*PAGE, *[r6(F.col(c), c) for c in ("char_w", "char_h", "std_w", "std_h")])


def char_size_clusters(spark, d):
    return V.char_size_clusters(_located(spark, d))


def fuse_align(spark, d):
    return V.align(V.tokenised(_vlm(spark, d)), _located(spark, d))


def orphan_segments(spark, d):
    return V.orphan_segments(V.align(V.tokenised(_vlm(spark, d)), _located(spark, d)))


def neighbor_anchors(spark, d):
    """The nearest sure words before and behind every word that is not sure."""
    w = harmonized_rows(spark, d).where("text <> ''").withColumn("sure", F.when(F.col("conf") >= 90, F.col("word_id")))
    o = Window.partitionBy(*PAGE).orderBy("word_id")
    w = w.withColumn("left_id", F.last("sure", True).over(o.rowsBetween(Window.unboundedPreceding, -1))).withColumn("right_id", F.first("sure", True).over(o.rowsBetween(1, Window.unboundedFollowing)))
    return w.where("sure is null").select("word_id", "left_id", "right_id")


def interpolate_boxes(spark, d):
    """Where every unsure word would stand if only its sure neighbours were known."""
    w = _located(spark, d)
    b = w.select("word_id", *BOX)
    a = neighbor_anchors(spark, d).join(w.select(*PAGE, "word_id", "text"), "word_id").join(V.char_sizes(w), PAGE)
    for side, p in (("left_id", "l_"), ("right_id", "r_")):
        a = a.join(b.select(F.col("word_id").alias(side), *[F.col(c).alias(f"{p}{c}") for c in BOX]), side, "left")
    return a.select("word_id", *V.interpolated()).select("word_id", *[r6(F.col(c), c) for c in BOX])


def wrap_placement(spark, d):
    """The words of every page's free text set from the margin on."""
    v = _vlm(spark, d).join(V.char_sizes(_located(spark, d)), PAGE)
    p = v.select(*PAGE, F.posexplode(V.wrapped(X.tokens(F.col("vlm_text")), F.lit(V.MARGIN + V.INDENT), F.lit(V.FIRST_LINE), V.FIRST_LINE + F.col("char_h"), F.col("char_w"), F.col("char_h"))).alias("k", "w"))
    return p.select(*PAGE, big(F.col("k"), "k"), "w.text", *[F.round(f"w.{b}", 4).alias(b) for b in BOX])


def fuse_full(spark, d):
    regions = harmonized_rows(spark, d).where("status = 'pixel'").select(*PAGE, *BOX)
    return V.fuse(V.tokenised(_vlm(spark, d)), _located(spark, d), regions).select(*PAGE, "position", "text", "status", "confidence", *[F.round(b, 4).alias(b) for b in BOX])


# -- evaluation ------------------------------------------------------------------------------------------------------


def _found_and_truth(spark, d):
    """The words of every secondary engine, and those of the primary as truth."""
    w = engine_rows(spark, d)
    return w.where("engine <> 'tesseract'"), w.where("engine = 'tesseract'")


def match_words_iou(spark, d):
    return M.match_to_truth(*_found_and_truth(spark, d), by=["engine"]).select("engine", "found_id", "truth_id", r6(F.col("iou"), "iou"))


def evaluate(spark, d):
    """Every engine against the primary as truth."""
    f, t = _found_and_truth(spark, d)
    return M.evaluation(f, t, M.match_to_truth(f, t, by=["engine"]), by=["engine"])


def evaluate_pass(spark, d):
    """The same with the pass mark of the compact preset, 0.8."""
    f, t = _found_and_truth(spark, d)
    return M.evaluation(f, t, M.match_to_truth(f, t, by=["engine"]), by=["engine"], pass_mark=0.8).select("engine", "f1", "passed")


def validate_matches(spark, d):
    """True words in order each take the first acceptable found word of an engine that is free."""
    f, t = (w.withColumn("norm", X.normalised_letters(F.col("text"))) for w in _found_and_truth(spark, d))
    p = M.banded_pairs(t, f).where(M.acceptable())
    p = p.select(F.col("l_file_id").alias("file_id"), F.col("l_page").alias("page"), F.col("r_engine").alias("engine"), F.col("l_word_id").alias("truth_id"), F.col("r_word_id").alias("found_id"), F.lit(0.0).alias("score"))
    return M.greedy_assign(p, [*PAGE, "engine"], "truth_id", "found_id", "score").select("engine", "truth_id", "found_id")


def word_misses(spark, d):
    """The first ten words of the truth that no word of an engine stands for, by engine; the report is that long by design."""
    f, t = _found_and_truth(spark, d)
    hit = M.match_to_truth(f, t, by=["engine"]).select("engine", F.col("truth_id").alias("word_id"))
    each = F.explode(F.array(*[F.lit(e) for e in H.Config().secondaries])).alias("engine")
    missed = t.select("word_id", "text", each).join(hit, ["engine", "word_id"], "left_anti")  # a handful of engines
    return missed.withColumn("n", F.row_number().over(Window.partitionBy("engine").orderBy("word_id"))).where("n <= 10").select("engine", "word_id", "text")


# -- streams ---------------------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _counted(stream, count, name: str):
    """The sum of the counts of every batch of a stream: ``count`` gives a batch's counts, whose last column adds up. A batch that is repeated
    overwrites its own folder; nothing is kept as state, so rows may come however late, and nothing comes to the driver."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession, name)
    *by, n = count(spark.createDataFrame([], stream.schema)).columns
    stream.writeStream.foreachBatch(lambda rows, i: count(rows).write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*by).agg(F.sum(n).alias(n))


def _written(stream, name: str):
    """What a stream appends, written as Parquet and read back."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _slim_stream(spark, d):
    """words_slim as a stream of files, whether the table is one file or a folder of them: the folder that holds it is read, filtered by name."""
    schema = table(spark, d, "words_slim").schema
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d.rstrip('/')}/words_slim.parquet*")
    return s.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))


def stream_entities(spark, d):
    """Entities of arriving words counted by day of arrival and kind, a batch of files at a time."""

    def count(rows):
        return rows.select(F.date_format("loaded_at", "yyyy-MM-dd").alias("day"), E.entity_of(F.col("text"), F.lit(False)).alias("entity")).groupBy("day", "entity").agg(F.count(F.lit(1)).alias("words"))

    return _counted(_slim_stream(spark, d), count, "stream_entities")


def stream_windows(spark, d):
    """Arriving words and those tagged, by kind of count, in windows of a week."""

    def count(rows):
        w = rows.where("loaded_at is not null").withColumn("tagged", E.entity_of(F.col("text"), F.lit(False)) != "").groupBy(F.window("loaded_at", "7 days").alias("w"), "tagged").agg(F.count(F.lit(1)).alias("words"))
        return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "tagged", "words")

    return _counted(_slim_stream(spark, d), count, "stream_windows")


def stream_deduplicated(spark, d):
    """Arriving words, each once: re-deliveries within the watermark of 90 days fall away as they come, later ones when the result is read."""
    t = tagged_stream(_slim_stream(spark, d), late="90 days").select("word_id", "entity")
    return _written(t, "stream_deduplicated").distinct()


def flagship(spark, d):
    """Engine words harmonised, put in reading order, sanitised and tagged."""
    h = cut(H.harmonize(engine_rows(spark, d)).drop("position"))
    order = L.reading_order(h.where("text <> ''")).select("word_id", "position")
    clean = S.sanitize(h.withColumn("engine", F.lit("")), _entries(spark, d)).select("word_id", "sanitized_text", F.col("status").alias("sanitize_status"))
    clean = cut(clean)
    names = _entries(spark, d).where("dictionary = 'place'").select(F.col("term").alias("name"))
    tagged = E.tag_entities(h.join(clean, "word_id"), names, text="sanitized_text")
    return tagged.join(order, "word_id").select(*PAGE, "position", "word_id", "text", "sanitized_text", "status", "sanitize_status", "source", "entity")


def pipeline(spark, d):
    return flagship(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        match_candidates, match_engine_words, line_match, known_words, weighted_vote, vote_weights, suppressed_words, corroborated_words, duplicate_pairs, fragment_words, unmatched_secondary, harmonize_full, harmonize_two_engines,
        dict_exact, dict_fuzzy, sanitize_skip_preserve, sanitize_full, sanitize_unranked, sanitize_metrics, rank_frequency, rank_document, rank_bigram, rank_ocr_model, case_transfer, bigram_totals, context_windows,
        distance_thresholds, y_fuzz, text_rows, column_boundaries, assigned_columns, cluster_edges, clusters, reading_order, reading_order_compact, cluster_outliers, reconstruct_lines, order_concordance,
        context_signatures, char_sizes, char_size_clusters, fuse_align, orphan_segments, neighbor_anchors, interpolate_boxes, wrap_placement, fuse_full,
        match_words_iou, evaluate, evaluate_pass, validate_matches, word_misses, stream_entities, stream_windows, stream_deduplicated, pipeline,
    )
}
_ENTITY = W.entity_sql("text", names=False)
_KEPT = _PRESERVE.split("SELECT word_id, ", 1)
_UNRANKED = f"""{_KEPT[0]}SELECT w.*, {_KEPT[1].removesuffix(" FROM w")} FROM w"""
_UNRANKED = f"""WITH {SW}, t AS (SELECT DISTINCT term AS t FROM dict_terms), l AS (SELECT DISTINCT term_lower AS l FROM dict_terms), w AS (SELECT *, {core('text')} AS core FROM sw), p AS ({_UNRANKED.split("AS core FROM sw)", 1)[1]}),
q AS (SELECT DISTINCT core, lower(core) AS q FROM p WHERE skip IS NULL AND preserve IS NULL AND core <> ''), tl AS (SELECT DISTINCT term_lower FROM dict_terms WHERE term_lower <> ''),
d AS (SELECT q, term_lower, {Q.lev('q', 'term_lower')} AS n FROM (SELECT DISTINCT q FROM q) JOIN tl ON abs(length(q) - length(term_lower)) <= 3),
c AS (SELECT q, e.term, e.dictionary, n, {_RANK.format('e.dictionary')} AS r, e.ord, CASE WHEN n <= 2 THEN round(weight * (1 - n / 3), 9) END AS s2, CASE WHEN n > 0 THEN round(weight * (1 - n / 4), 9) END AS s3 FROM d JOIN dict_terms e USING (term_lower) WHERE n <= 3),
b2 AS (SELECT q, s2, n, term FROM c WHERE s2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY s2 DESC, n, r, ord, term, dictionary) = 1), b3 AS (SELECT q, s3, n, term FROM c WHERE s3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY s3 DESC, n, r, ord, term, dictionary) = 1),
m AS (SELECT p.*, s2, b2.n AS n2, b2.term AS t2, s3, b3.n AS n3, b3.term AS t3, skip IS NULL AND preserve IS NULL AND coalesce(s2 >= 0.3, false) AS fix, skip IS NULL AND preserve IS NULL AND NOT coalesce(s2 >= 0.3, false) AND coalesce(s3 >= 0.2, false) AS ctx FROM p LEFT JOIN b2 ON lower(core) = b2.q AND skip IS NULL AND preserve IS NULL AND core <> '' LEFT JOIN b3 ON lower(core) = b3.q AND skip IS NULL AND preserve IS NULL AND core <> ''),
x AS (SELECT *, CASE WHEN fix THEN t2 ELSE t3 END AS term, substr(text, 1, length(text) - length(ltrim(text, '{EDGE}'))) AS pre, right(ltrim(text, '{EDGE}'), length(ltrim(text, '{EDGE}')) - length(core)) AS post FROM m)
SELECT word_id, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN preserve IS NOT NULL THEN 'preserved' WHEN fix THEN CASE WHEN n2 = 0 THEN 'preserved' ELSE 'corrected' END WHEN ctx THEN 'context' ELSE 'uncertain' END AS status,
  CASE WHEN fix OR ctx THEN pre || {Q.like_case('term', 'core')} || post ELSE text END AS sanitized_text, (CASE WHEN fix THEN n2 WHEN ctx THEN n3 ELSE 0 END)::bigint AS edit_distance,
  round(CASE WHEN skip IS NOT NULL THEN 0 WHEN preserve IS NOT NULL THEN 1 WHEN fix THEN s2 WHEN ctx THEN s3 ELSE 0 END, 6) AS correction_score FROM x"""
_ASCII = "translate({0}, 'éèêëïîìôöòóüûùúàâäãáçñßøåæœ’‘“”­​⁠﻿', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#$%&=<>+_~^|')"
ORACLE = {
    "match_candidates": _CAND,
    "known_words": _KNOWN,
    "weighted_vote": _VOTE,
    "corroborated_words": _BACKED,
    "suppressed_words": _SUPPRESSED,
    "duplicate_pairs": _DUP,
    "fragment_words": _FRAG,
    "dict_exact": _EXACT,
    "dict_fuzzy": f"WITH {SW}, c AS (SELECT DISTINCT lower({core('text')}) AS query FROM sw WHERE {core('text')} <> ''), t AS (SELECT DISTINCT term_lower FROM dict_terms WHERE term_lower <> '') SELECT query, term_lower, levenshtein({_ASCII.format('query')}, {_ASCII.format('term_lower')})::bigint AS distance FROM c JOIN t ON abs(length(query) - length(term_lower)) <= 2 AND levenshtein({_ASCII.format('query')}, {_ASCII.format('term_lower')}) <= 2",
    "sanitize_skip_preserve": _PRESERVE,
    "sanitize_metrics": "WITH r AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM sanitize_results) SELECT count(*) AS total, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'preserved') AS preserved, count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'context') AS context, count(*) FILTER (status = 'uncertain') AS uncertain, round(count(*) FILTER (status IN ('preserved', 'corrected', 'context')) / count(*), 6) AS coverage FROM r",
    "rank_frequency": f"WITH {_CORES}, u AS (SELECT w AS word, count(*) AS n FROM c WHERE w <> '' GROUP BY w) SELECT word, round(log10(n + 1) / log10((SELECT max(n) FROM u) + 1), 6) AS factor FROM u",
    "rank_document": f"WITH {_CORES} SELECT file_id, w AS word, round(CASE WHEN count(*) >= 2 THEN 1 + 0.3 * log10(count(*) + 1) ELSE 1 END, 6) AS factor FROM c WHERE w <> '' GROUP BY file_id, w",
    "rank_bigram": f"WITH {_TWO}, p AS (SELECT word_id, x.n / ub.n AS p1, y.n / uw.n AS p2 FROM b LEFT JOIN k x ON x.w1 = b.wb AND x.w2 = b.w LEFT JOIN u ub ON ub.w = b.wb LEFT JOIN k y ON y.w1 = b.w AND y.w2 = b.wa LEFT JOIN u uw ON uw.w = b.w WHERE b.w <> ''), m AS (SELECT word_id, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN (p1 + p2) / 2 ELSE coalesce(p1, p2) END AS p FROM p) SELECT word_id, round(CASE WHEN p IS NULL OR p <= 0 THEN 1 ELSE least(2, greatest(0.5, 1 + 0.5 * log10(1e6 * p + 1) / 10)) END, 6) AS factor FROM m",
    "distance_thresholds": f"WITH {Q.LOC}{Q.thresholds()} SELECT file_id, page, round(x_threshold, 6) AS x_threshold, round(y_threshold, 6) AS y_threshold FROM thr",
    "y_fuzz": f"WITH {Q.LOC}{Q.thresholds()}{Q.fuzz()} SELECT file_id, page, round(fuzz, 12) AS fuzz FROM fuzz",
    "text_rows": f'WITH {Q.LOC}{Q.thresholds()}{Q.fuzz()}{Q.ROWS} SELECT word_id, "row"::bigint AS "row" FROM rw',
    "column_boundaries": f"WITH {Q.LOC}{Q.thresholds()}{Q.fuzz()}{Q.ROWS}{Q.BOUNDS} SELECT file_id, page, coalesce(n, 0) AS n, round(coalesce(f, 0), 6) AS first, round(coalesce(l, 0), 6) AS last FROM (SELECT DISTINCT file_id, page FROM w) LEFT JOIN bd USING (file_id, page)",
    "assigned_columns": f"WITH {Q.LOC}{Q.thresholds()}{Q.fuzz()}{Q.ROWS}{Q.BOUNDS} SELECT word_id, (SELECT count(DISTINCT mid) FROM bg WHERE bg.file_id = w.file_id AND bg.page = w.page AND mid <= w.cx) AS col FROM w",
    "cluster_edges": f"WITH {Q.LOC}{Q.thresholds()}{Q.fuzz()}{Q.ROWS}{Q.BOUNDS}{Q.edges()} SELECT file_id, page, rule::bigint AS rule, count(*) AS edges FROM ed GROUP BY ALL",
    "context_signatures": f"WITH {Q.LOC} SELECT word_id, string_agg(text, ' ') OVER (PARTITION BY file_id, page ORDER BY word_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM w",
    "char_sizes": f"WITH {Q.LOC}, a AS (SELECT file_id, page, avg((x1 - x0) / length(text)) AS cw, avg(y1 - y0) AS ch, stddev_samp((x1 - x0) / length(text)) AS sw, stddev_samp(y1 - y0) AS sh FROM w WHERE x1 > x0 AND y1 > y0 GROUP BY file_id, page) SELECT file_id, page, round(coalesce(cw, 10), 6) AS char_w, round(coalesce(ch, 15), 6) AS char_h, round(coalesce(sw, 0), 6) AS std_w, round(coalesce(sh, 0), 6) AS std_h FROM (SELECT DISTINCT file_id, page FROM w) LEFT JOIN a USING (file_id, page)",
    "neighbor_anchors": f"WITH {HW}, w AS (SELECT file_id, page, word_id, CASE WHEN conf >= 90 THEN word_id END AS sure FROM hw WHERE text <> ''), a AS (SELECT *, last_value(sure IGNORE NULLS) OVER (PARTITION BY file_id, page ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_id, first_value(sure IGNORE NULLS) OVER (PARTITION BY file_id, page ORDER BY word_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_id FROM w) SELECT word_id, left_id, right_id FROM a WHERE sure IS NULL",
    "case_transfer": f"WITH {HW}, {_READ} SELECT word_id, engine, {Q.like_case("lower(trim(text, ' '))", 'reading')} AS cased FROM rd",
    "rank_ocr_model": _ocr_sql(),
    "bigram_totals": f"WITH {_TWO} SELECT word, sum(n)::bigint AS n FROM (SELECT w1 AS word, n FROM k UNION ALL SELECT w2, n FROM k) GROUP BY word",
    "context_windows": f"WITH {SW} SELECT word_id, array_to_string(list_concat(coalesce(list(lower(text)) OVER (PARTITION BY file_id, page ORDER BY word_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), coalesce(list(lower(text)) OVER (PARTITION BY file_id, page ORDER BY word_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), [])), ' ') AS context FROM sw",
    "clusters": f"{Q.clustered()} SELECT word_id, cluster, {', '.join(f'round(c_{b}, 6) AS c_{b}' for b in BOX)} FROM clb",
    "reading_order": f'{Q.clustered()}{Q.ORDER} SELECT word_id, cluster, band, "row", position FROM ro',
    "reading_order_compact": f'{Q.clustered(L.COMPACT)}{Q.ORDER} SELECT word_id, cluster, band, "row", position FROM ro',
    "order_concordance": f"{Q.clustered()}{Q.ORDER}, pp AS (SELECT l.file_id, l.page, count(*) AS n, count(*) FILTER ((l.position < r.position) = (l.word_id < r.word_id)) AS ok FROM ro l JOIN ro r ON {Q.ON_PAGE} AND l.word_id < r.word_id GROUP BY ALL) SELECT file_id, page, round(coalesce((2 * ok - n) / n, 1), 6) AS concordance FROM (SELECT DISTINCT file_id, page FROM ro) LEFT JOIN pp USING (file_id, page)",
    "cluster_outliers": f"""{Q.clustered()}, m AS (SELECT *, avg(cx) OVER p AS mx, avg(cy) OVER p AS my FROM clb WINDOW p AS (PARTITION BY file_id, page, cluster)), f AS (SELECT *, sqrt(pow(cx - mx, 2) + pow(cy - my, 2)) AS far FROM m),
      st AS (SELECT *, sqrt(pow(lead(cx) OVER o - cx, 2) + pow(lead(cy) OVER o - cy, 2)) AS step, lead(far) OVER o AS far2, lead(word_id) OVER o AS id2 FROM f WINDOW o AS (PARTITION BY file_id, page, cluster ORDER BY cy, cx, word_id)),
      av AS (SELECT *, avg(step) OVER (PARTITION BY file_id, page, cluster) AS mean FROM st), who AS (SELECT DISTINCT CASE WHEN far > far2 THEN word_id ELSE id2 END AS word_id FROM av WHERE step > {L.Config().outlier_times} * mean)
      SELECT word_id, cluster, 2 * (mx - cx) + (my - cy) > 0 AS front FROM who JOIN f USING (word_id)""",
    "reconstruct_lines": f"""WITH RECURSIVE {Q.LOC}, t AS (SELECT file_id, page, avg(y1 - y0) FILTER (y1 - y0 > 0) AS tall FROM w GROUP BY file_id, page), i AS (SELECT w.*, tall, row_number() OVER (PARTITION BY w.file_id, w.page ORDER BY word_id) AS n FROM w JOIN t ON w.file_id = t.file_id AND w.page = t.page),
      s AS (SELECT file_id, page, n, 0::bigint AS line, text AS word, x0, y0, x1, y1, x0 AS last FROM i WHERE n = 1 UNION ALL SELECT file_id, page, n, CASE WHEN more THEN line ELSE line + 1 END, word, CASE WHEN more THEN least(x0, a0) ELSE a0 END, CASE WHEN more THEN least(y0, b0) ELSE b0 END, CASE WHEN more THEN greatest(x1, a1) ELSE a1 END, CASE WHEN more THEN greatest(y1, b1) ELSE b1 END, a0
        FROM (SELECT s.file_id, s.page, i.n, s.line, i.text AS word, s.x0, s.y0, s.x1, s.y1, i.x0 AS a0, i.y0 AS b0, i.x1 AS a1, i.y1 AS b1, abs((i.y0 + i.y1) / 2 - (s.y0 + s.y1) / 2) <= 1.5 * tall AND NOT i.x0 < s.last - 2 * tall AS more FROM s JOIN i ON i.file_id = s.file_id AND i.page = s.page AND i.n = s.n + 1))
      SELECT file_id, page, line, string_agg(word, ' ' ORDER BY n) AS text, count(*) AS n_words, {', '.join(f'round(arg_max({b}, n), 6) AS {b}' for b in BOX)} FROM s GROUP BY file_id, page, line""",
    "char_size_clusters": f"""WITH RECURSIVE {Q.LOC}, i AS (SELECT file_id, page, h, row_number() OVER (PARTITION BY file_id, page ORDER BY h) AS k FROM (SELECT file_id, page, round(y1 - y0, 6) AS h FROM w WHERE y1 - y0 > 0)),
      s AS (SELECT file_id, page, k, 0::bigint AS cluster, 1::bigint AS n, h AS s, h * h AS q FROM i WHERE k = 1 UNION ALL SELECT file_id, page, k, CASE WHEN more THEN cluster ELSE cluster + 1 END, CASE WHEN more THEN n + 1 ELSE 1 END, CASE WHEN more THEN s + h ELSE h END, CASE WHEN more THEN q + h * h ELSE h * h END
        FROM (SELECT s.file_id, s.page, i.k, s.cluster, s.n, s.s, s.q, i.h, abs(i.h - s.s / s.n) <= 2 * CASE WHEN greatest(s.q / s.n - (s.s / s.n) * (s.s / s.n), 0) > 0 THEN sqrt(s.q / s.n - (s.s / s.n) * (s.s / s.n)) ELSE 1 END AS more FROM s JOIN i ON i.file_id = s.file_id AND i.page = s.page AND i.k = s.k + 1))
      SELECT file_id, page, cluster, max(n) AS n, round(arg_max(s / n, k), 9) AS mean_h FROM s GROUP BY file_id, page, cluster""",
    "wrap_placement": f"""WITH RECURSIVE {Q.LOC}{Q.SIZES}, v AS (SELECT file_id, page, string_agg(doctr_text, ' ' ORDER BY word_id) AS t FROM hw WHERE doctr_text <> '' GROUP BY file_id, page), l AS (SELECT file_id, page, list_filter(string_split_regex(t, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws FROM v),
      i AS (SELECT l.file_id, l.page, char_w, char_h, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k FROM l JOIN sz ON l.file_id = sz.file_id AND l.page = sz.page), j AS (SELECT *, char_w * length(text) AS wd FROM i),
      s AS (SELECT file_id, page, k, text, CASE WHEN {Q.LEFT} + wd > {Q.RIGHT} THEN {Q.LEFT} ELSE {Q.LEFT} END::double AS x0, ({Q.TOP} + CASE WHEN {Q.LEFT} + wd > {Q.RIGHT} THEN char_h + {Q.LINE} ELSE 0 END)::double AS y0, wd, char_w, char_h FROM j WHERE k = 0
        UNION ALL SELECT file_id, page, k, text, CASE WHEN wrap THEN {Q.LEFT} ELSE x END, CASE WHEN wrap THEN y0 + char_h + {Q.LINE} ELSE y0 END, wd, char_w, char_h FROM (SELECT j.file_id, j.page, j.k, j.text, j.wd, j.char_w, j.char_h, s.y0, s.x0 + s.wd + {Q.GAP} * j.char_w AS x, s.x0 + s.wd + {Q.GAP} * j.char_w + j.wd > {Q.RIGHT} AS wrap FROM s JOIN j ON j.file_id = s.file_id AND j.page = s.page AND j.k = s.k + 1))
      SELECT file_id, page, k::bigint AS k, text, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x0 + wd, 4) AS x1, round(y0 + char_h, 4) AS y1 FROM s""",
    "interpolate_boxes": f"""WITH {Q.LOC}{Q.SIZES}, n AS (SELECT *, CASE WHEN conf >= 90 THEN word_id END AS sure FROM w), a AS (SELECT n.*, last_value(sure IGNORE NULLS) OVER (PARTITION BY file_id, page ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li, first_value(sure IGNORE NULLS) OVER (PARTITION BY file_id, page ORDER BY word_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ri FROM n),
      b AS (SELECT a.word_id, char_w * length(a.text) AS wd, char_h, l.x0 AS lx0, l.y0 AS ly0, l.x1 AS lx1, l.y1 AS ly1, r.x0 AS rx0, r.y0 AS ry0, r.x1 AS rx1, r.y1 AS ry1 FROM a JOIN sz ON a.file_id = sz.file_id AND a.page = sz.page LEFT JOIN w l ON l.word_id = li LEFT JOIN w r ON r.word_id = ri WHERE sure IS NULL),
      c AS (SELECT *, lx0 IS NOT NULL AS hl, rx0 IS NOT NULL AS hr, coalesce(least(ly1, ry1) - greatest(ly0, ry0) > 0 OR abs((ly0 + ly1) / 2 - (ry0 + ry1) / 2) < 20, false) AS near, rx0 - lx1 - 4 AS room FROM b),
      e AS (SELECT *, hl AND hr AND near AS same, CASE WHEN hl THEN lx1 + 2 WHEN hr THEN greatest(0, rx0 - 2 - wd) ELSE 50 END AS p0 FROM c), f AS (SELECT *, CASE WHEN same THEN p0 + CASE WHEN room > 0 THEN least(wd, room) ELSE wd END WHEN hr AND NOT hl THEN rx0 - 2 ELSE p0 + wd END AS p1 FROM e)
      SELECT word_id, round(p0, 6) AS x0, round(CASE WHEN same THEN (ly0 + ry0) / 2 WHEN hl THEN ly0 WHEN hr THEN ry0 ELSE 100 END, 6) AS y0, round(CASE WHEN p1 <= p0 THEN p0 + wd ELSE p1 END, 6) AS x1, round(CASE WHEN same THEN (ly1 + ry1) / 2 WHEN hl THEN ly1 WHEN hr THEN ry1 ELSE 100 + char_h END, 6) AS y1 FROM f""",
    "sanitize_unranked": _UNRANKED,
    "stream_entities": f"SELECT strftime(loaded_at, '%Y-%m-%d') AS day, {_ENTITY} AS entity, count(*) AS words FROM words_slim GROUP BY ALL",
    "stream_windows": f"SELECT strftime(time_bucket(INTERVAL 7 DAY, loaded_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, ({_ENTITY}) <> '' AS tagged, count(*) AS words FROM words_slim WHERE loaded_at IS NOT NULL GROUP BY ALL",
    "stream_deduplicated": f"SELECT DISTINCT word_id, {_ENTITY} AS entity FROM words_slim",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}

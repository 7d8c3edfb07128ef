"""Queries on single words: geometry, text, entities, triage, regions, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspan.functions import geometry as G
from leafspan.functions import patterns as P
from leafspan.functions import text as X
from leafspan.operators import entities as E
from leafspan.operators import harmonize as H
from leafspan.operators import quality as Q
from leafspan.operators.matching import banded_pairs
from leafspan.plans.base import BOX, EW, HW, SW, core, engine_rows, harmonized_rows, slim_rows
from leafspan.plans.sql import lev
from leafspan.sources import files, scans, table

r6 = lambda c, name: F.round(c, 6).alias(name)
big = lambda c, name: c.cast("bigint").alias(name)


def bbox_geometry(spark, d):
    return harmonized_rows(spark, d).select("word_id", r6(G.width(), "width"), r6(G.height(), "height"), r6(G.area(), "area"), r6(G.center_x(), "center_x"), r6(G.center_y(), "center_y"))


def point_containment(spark, d):
    """Whether each word's box holds the center of the text area of its page."""
    w = harmonized_rows(spark, d)
    mid = w.groupBy("file_id", "page").agg(((F.min("x0") + F.max("x1")) / 2).alias("mx"), ((F.min("y0") + F.max("y1")) / 2).alias("my"))
    return w.join(mid, ["file_id", "page"]).select("word_id", G.contains("", F.col("mx"), F.col("my")).alias("inside"))


def bbox_pairs(spark, d):
    """Measures of the pairs of different engines' words whose centers are within 12 points vertically."""
    w = engine_rows(spark, d)
    p = banded_pairs(w, w, 12.0).where((F.col("l_engine") < F.col("r_engine")) & (F.abs(G.center_y("l_") - G.center_y("r_")) <= 12))
    return p.select(F.col("l_word_id").alias("a"), F.col("r_word_id").alias("b"), r6(G.iou("l_", "r_"), "iou"), r6(G.gap("l_", "r_", "x"), "gap_x"), r6(G.gap("l_", "r_", "y"), "gap_y"), r6(G.overlap_ratio("l_", "r_", "x"), "overlap_x"), r6(G.overlap_ratio("l_", "r_", "y"), "overlap_y"), r6(G.center_distance("l_", "r_"), "distance"), G.same_line("l_", "r_").alias("same_line"))


_PAIRS = f"""WITH {EW}, p AS (SELECT l.word_id AS a, r.word_id AS b, l.x0 AS lx0, l.y0 AS ly0, l.x1 AS lx1, l.y1 AS ly1, r.x0 AS rx0, r.y0 AS ry0, r.x1 AS rx1, r.y1 AS ry1,
  least(l.x1, r.x1) - greatest(l.x0, r.x0) AS ox, least(l.y1, r.y1) - greatest(l.y0, r.y0) AS oy
  FROM ew l JOIN ew r ON l.file_id = r.file_id AND l.page = r.page AND l.engine < r.engine AND abs((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2) <= 12),
q AS (SELECT *, (lx1 - lx0) * (ly1 - ly0) + (rx1 - rx0) * (ry1 - ry0) - ox * oy AS u, least(lx1 - lx0, rx1 - rx0) AS sx, least(ly1 - ly0, ry1 - ry0) AS sy, abs((ly0 + ly1) / 2 - (ry0 + ry1) / 2) AS dy, (lx0 + lx1) / 2 - (rx0 + rx1) / 2 AS dx FROM p)
SELECT a, b, round(CASE WHEN ox > 0 AND oy > 0 AND u > 0 THEN ox * oy / u ELSE 0 END, 6) AS iou, round(greatest(-ox, 0) + 0, 6) AS gap_x, round(greatest(-oy, 0) + 0, 6) AS gap_y,
  round(CASE WHEN sx > 0 THEN greatest(ox, 0) / sx ELSE 0 END, 6) AS overlap_x, round(CASE WHEN sy > 0 THEN greatest(oy, 0) / sy ELSE 0 END, 6) AS overlap_y,
  round(sqrt(dx * dx + dy * dy), 6) AS distance, oy > 0 OR dy < 20 AS same_line FROM q"""


def rotate_bbox(spark, d):
    p = table(spark, d, "pages_meta").groupBy("file_id", "page").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    j = harmonized_rows(spark, d).join(p, ["file_id", "page"])
    return j.select("word_id", "rotation", *G.rotated_back(F.col("rotation"), F.col("w"), F.col("h"))).select("word_id", "rotation", *[r6(F.col(c), c) for c in BOX])


def scale_px_to_pt(spark, d):
    return slim_rows(spark, d).select("word_id", *G.scaled("", 72 / 300, 72 / 300)).select("word_id", *[r6(F.col(c), c) for c in BOX])


def clamp_confidence(spark, d):
    shift = F.when(F.col("engine") == "doctr", 12.0).when(F.col("engine") == "tesseract", -20.0).otherwise(0.0)
    return engine_rows(spark, d).select("word_id", r6(G.adjusted_confidence(F.col("confidence"), shift), "confidence"))


def scan_scaled(spark, d):
    return scans.scaled_words(engine_rows(spark, d), 0.24, 0.24).select("word_id", "text", *[r6(F.col(c), c) for c in BOX], "confidence")


def scan_polygons(spark, d):
    """Boxes of slanted four-corner polygons."""
    w = engine_rows(spark, d).select("word_id", F.array("x0", "x1", F.col("x1") - 1, F.col("x0") - 1).alias("xs"), F.array("y0", F.col("y0") + 2, F.col("y1") + 2, "y1").alias("ys"))
    return w.select("word_id", *scans.polygon_box(F.col("xs"), F.col("ys"))).select("word_id", *[r6(F.col(c), c) for c in BOX])


def line_split_width(spark, d):
    return scans.split_by_width(engine_rows(spark, d)).select("word_id", "part", "text", *[r6(F.col(c), c) for c in BOX])


def line_split_letters(spark, d):
    return scans.split_by_letters(engine_rows(spark, d)).select("word_id", "part", "text", *[r6(F.col(c), c) for c in BOX])


_SPLIT = f"""WITH {EW}, l AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws FROM ew),
w AS (SELECT word_id, x0, y0, x1, y1, len(ws) AS n, list_sum(list_transform(ws, lambda x: length(x))) AS total, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS part FROM l WHERE len(ws) > 0)
"""
_SPLIT_WIDTH = _SPLIT + """, s AS (SELECT *, CASE WHEN n > 1 THEN (length(text) + 0.25::double) / (total + 0.5::double * (n - 1)) * (x1 - x0) ELSE x1 - x0 END AS w FROM w),
t AS (SELECT *, x0 + coalesce(sum(w) OVER (PARTITION BY word_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM s)
SELECT word_id, part::bigint AS part, text, round(s0, 6) AS x0, round(y0, 6) AS y0, round(least(s0 + w, x1), 6) AS x1, round(y1, 6) AS y1 FROM t"""
_SPLIT_LETTERS = _SPLIT + """, s AS (SELECT *, (x1 - x0) / (total + n - 1) AS c, coalesce(sum(length(text) + 1) OVER (PARTITION BY word_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w),
t AS (SELECT *, least(x0 + c * b, x1) AS s0 FROM s)
SELECT word_id, part::bigint AS part, text, round(s0, 6) AS x0, round(y0, 6) AS y0, round(least(s0 + c * length(text), x1), 6) AS x1, round(y1, 6) AS y1 FROM t"""


def _characters(spark, d):
    """The characters of every slim word as an engine of characters gives them: cuts of equal width."""
    w = slim_rows(spark, d).where("text <> ''").withColumn("n", F.length("text"))
    c = w.select(F.col("word_id").alias("line_id"), F.posexplode(F.split("text", "")).alias("pos", "char"), "x0", "y0", "y1", ((F.col("x1") - F.col("x0")) / F.col("n")).alias("cw"), (F.col("confidence") / 100).alias("conf"))
    return c.select("line_id", F.col("pos").cast("bigint").alias("pos"), "char", (F.col("x0") + F.col("pos") * F.col("cw")).alias("x0"), "y0", (F.col("x0") + (F.col("pos") + 1) * F.col("cw")).alias("x1"), "y1", "conf")


def char_islands(spark, d):
    return scans.words_of_characters(_characters(spark, d)).select("line_id", "word_no", "text", *[r6(F.col(c), c) for c in BOX], r6(F.col("confidence"), "confidence"))


def ctc_decode(spark, d):
    """Every character twice with a blank behind: decoding gives the text back."""
    c = _characters(spark, d).select(F.col("line_id").alias("id"), F.col("pos"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.lit(k < 2), F.col("char")).otherwise("").alias("symbol")) for k in range(3)])).alias("s"), "conf")
    return scans.ctc_decoded(c.select("id", (F.col("pos") * 3 + F.col("s.k")).alias("step"), "s.symbol", F.col("conf").alias("prob")), "id").select("id", "text", r6(F.col("confidence"), "confidence"))


def tokenize_words(spark, d):
    """How many words between white space every document has."""
    return table(spark, d, "documents").select("doc_id", big(F.coalesce(F.size(X.tokens(F.col("text"))), F.lit(0)), "words"))


def word_at_position(spark, d):
    v = table(spark, d, "sanitize_results").select("result_id", "original_text").distinct().where(F.size(X.tokens(F.col("original_text"))) > 0)
    return v.select("result_id", *[X.word_at(F.col("original_text"), F.lit(r)).alias(n) for r, n in ((0.0, "first"), (0.5, "middle"), (0.99, "last"))])


_TOK = "list_filter(string_split_regex(original_text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
_AT = """coalesce(list_filter(list_zip(ws, ends), lambda z: z[2] >= floor({0}::double * total))[1][1], ws[len(ws)])"""
_WORD_AT = f"""WITH v AS (SELECT DISTINCT result_id, original_text FROM sanitize_results), t AS (SELECT result_id, {_TOK} AS ws FROM v),
e AS (SELECT result_id, ws, list_sum(list_transform(ws, lambda x: length(x))) + len(ws) - 1 AS total, list_transform(range(1, len(ws) + 1), lambda i: list_sum(list_transform(ws[1:i], lambda x: length(x) + 1)) - 1) AS ends FROM t WHERE len(ws) > 0)
SELECT result_id, {_AT.format('0.0')} AS first, {_AT.format('0.5')} AS middle, {_AT.format('0.99')} AS last FROM e"""


def text_measures(spark, d):
    """Every text measure of every word."""
    t = F.col("text")
    return harmonized_rows(spark, d).select("word_id", X.punctuation_only(t).alias("punctuation"), r6(X.digit_ratio(t), "digits"), X.normalised(t).alias("normalised"), X.core_of(t).alias("core"), X.prefix_of(t).alias("prefix"), X.suffix_of(t).alias("suffix"), X.compare_key(t).alias("compare"), X.strip_edges(t).alias("stripped"))


_W = "[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}]"
_TEXT = f"""WITH {HW} SELECT word_id, regexp_matches(text, '^[[:punct:]\\s]*$') AS punctuation,
  round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) ELSE 0 END, 6) AS digits, lower(trim(text, ' ')) AS normalised, {core('text')} AS core,
  substr(text, 1, length(text) - length(ltrim(text, '.,;:?!()[]{{}}"'''))) AS prefix,
  right(ltrim(text, '.,;:?!()[]{{}}"'''), length(ltrim(text, '.,;:?!()[]{{}}"''')) - length({core('text')})) AS suffix,
  trim(lower(text), '.:,') AS compare, regexp_replace(text, '^{_W}+|{_W}+$', '', 'g') AS stripped FROM hw"""


def garbage_text(spark, d):
    return harmonized_rows(spark, d).select("word_id", X.garbage(F.col("text")).alias("garbage"))


_GARBAGE = f"""WITH {HW} SELECT word_id, CASE WHEN length(text) < 2 THEN true WHEN contains(text, '@') OR contains(text, '.com') OR contains(text, '.org') THEN false
  ELSE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(text) < 0.6 OR regexp_matches(regexp_replace(text, '[aeiouAEIOU]', '0', 'g'), '\\p{{L}}{{4,}}')
  OR (length(text) > 3 AND regexp_matches(substr(text, 2, length(text) - 2), '\\p{{Lu}}') AND regexp_matches(substr(text, 2, length(text) - 2), '\\p{{Ll}}')) END AS garbage FROM hw"""


def concatenated(spark, d):
    others = F.array(*[F.coalesce(f"{e}_text", F.lit("")) for e in ("tess", "easy", "doctr", "surya")])
    return harmonized_rows(spark, d).where("paddle_text <> ''").select("word_id", X.concatenated(F.col("paddle_text"), others).alias("concatenated"))


_CONCAT = f"""WITH {HW} SELECT word_id, NOT contains(paddle_text, ' ') AND len(list_filter([coalesce(tess_text, ''), coalesce(easy_text, ''), coalesce(doctr_text, ''), coalesce(surya_text, '')],
  lambda o: length(o) > 0 AND length(paddle_text) > 1.5 * length(o))) > 0 AS concatenated FROM hw WHERE paddle_text <> ''"""


def engine_distances(spark, d):
    """The edit distance of each engine's reading to the voted text, -1 where it has none."""
    dist = [big(F.when(F.coalesce(f"{e}_text", F.lit("")) == "", -1).otherwise(F.levenshtein("text", f"{e}_text")), f"dist_{e}") for e in ("tess", "easy", "doctr", "paddle", "surya")]
    return harmonized_rows(spark, d).select("word_id", *dist)


def _tagged(spark, d):
    names = table(spark, d, "dict_terms").where("dictionary = 'place'").select(F.col("term").alias("name"))
    return E.tag_entities(harmonized_rows(spark, d), names)


def entity_tag(spark, d):
    return _tagged(spark, d).select("word_id", "entity", "redact")


def entity_stats(spark, d):
    return E.redaction_stats(_tagged(spark, d))


def redaction_drawlist(spark, d):
    return E.draw_list(_tagged(spark, d)).select("word_id", "page", *[r6(F.col(c), c) for c in BOX], "mode", "colour")


def redaction_preview(spark, d):
    return E.draw_list(_tagged(spark, d), preview=True).select("word_id", "mode", "colour")


def redaction_boxes(spark, d):
    return E.boxes_by_page(_tagged(spark, d)).select("file_id", "page", big(F.size("boxes"), "n"), F.get("boxes", F.lit(0))["word_id"].alias("first_id"))


def _any(patterns: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(trim(text), '{p}')" for p in patterns)


def entity_sql(text: str = "text", names: bool = True) -> str:
    name = "WHEN name IS NOT NULL THEN 'NAME' " if names else ""
    return f"CASE WHEN {text} IS NULL OR trim({text}) = '' OR {_any(P.EXCEPTIONS)} THEN '' WHEN {_any(P.DATES)} THEN 'DATE' WHEN {_any(P.CODES)} THEN 'CODE' {name}ELSE '' END"


_TAGGED = f"""{HW}, names AS (SELECT DISTINCT lower(trim(term)) AS name FROM dict_terms WHERE dictionary = 'place' AND trim(term) <> ''),
tagged AS (SELECT hw.*, {entity_sql()} AS entity
  FROM hw LEFT JOIN names ON lower(regexp_replace(text, '^{_W}+|{_W}+$', '', 'g')) = name)"""


def _triage(level):
    def query(spark, d):
        return Q.triage(slim_rows(spark, d), level, confidence="confidence", pixel=F.col("engine") == "pixel_detector", both=F.lit(False)).select("word_id")

    return query


def _triage_sql(level: str) -> str:
    t = Q.LEVELS[level]
    punct = "" if t.punctuation_confidence is None else f"AND NOT (regexp_matches(text, '^[[:punct:]\\s]*$') AND confidence < {t.punctuation_confidence})"
    return f"""WITH {SW} SELECT word_id FROM sw WHERE engine = 'pixel_detector' OR (length(trim(text)) >= 1 AND confidence >= {t.min_confidence}
  AND (y1 - y0 <= 0 OR (x1 - x0) / (y1 - y0) <= {t.max_aspect}) AND (x1 - x0) * (y1 - y0) >= {t.min_area} {punct})"""


def triage_stats(spark, d):
    return Q.triage_stats(slim_rows(spark, d).withColumnRenamed("confidence", "conf"), "normal")


def region_kinds(spark, d):
    """What each pixel row (and each box of words) would count as if it were a candidate region."""
    return harmonized_rows(spark, d).select("word_id", Q.region_kind().alias("kind"))


_KIND = """CASE WHEN w >= 100 AND h <= 10 AND (h <> 0 AND w / nullif(h, 0) >= 10) THEN 'horizontal' WHEN h >= 50 AND w <= 10 AND (w <> 0 AND h / nullif(w, 0) >= 5) THEN 'vertical'
  WHEN w * h >= 1000 AND NOT (w < 30 AND h < 30) AND greatest(w / nullif(h, 0), h / nullif(w, 0)) <= 20 THEN 'logo' WHEN w * h >= 50 AND w >= 10 AND h BETWEEN 5 AND 50 AND w / nullif(h, 0) <= 50 THEN 'text' END"""


def missed_regions(spark, d):
    """Pixel rows that no word of their page overlaps."""
    w = harmonized_rows(spark, d)
    return Q.overlaps_any(w.where("status = 'pixel'"), w.where("status <> 'pixel'"), ["file_id", "page"], "word_id").select("word_id")


_MISSED = f"""WITH {HW}, p AS (SELECT * FROM hw WHERE status = 'pixel') SELECT word_id FROM p WHERE NOT EXISTS (SELECT 1 FROM hw e WHERE e.status <> 'pixel' AND e.file_id = p.file_id AND e.page = p.page AND
  (((p.x0 + p.x1) / 2 BETWEEN e.x0 AND e.x1 AND (p.y0 + p.y1) / 2 BETWEEN e.y0 AND e.y1) OR (least(p.x1, e.x1) > greatest(p.x0, e.x0) AND least(p.y1, e.y1) > greatest(p.y0, e.y0) AND
  (least(p.x1, e.x1) - greatest(p.x0, e.x0)) * (least(p.y1, e.y1) - greatest(p.y0, e.y0)) / ((p.x1 - p.x0) * (p.y1 - p.y0) + (e.x1 - e.x0) * (e.y1 - e.y0) - (least(p.x1, e.x1) - greatest(p.x0, e.x0)) * (least(p.y1, e.y1) - greatest(p.y0, e.y0))) > 0.1)))"""


def csv_harmonized(spark, d):
    return files.harmonized_rows(harmonized_rows(spark, d), distances=True, pixel=False)


_CSV = f"""WITH {HW} SELECT word_id, page, round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1, text, status, source, round(conf, 1) AS conf, rotation,
  {', '.join(f"coalesce({e}_text, '') AS {e}" for e in ('tess', 'easy', 'doctr', 'paddle', 'surya'))}, {', '.join(f"CASE WHEN dist_{e} >= 0 THEN dist_{e} END AS dist_{e}" for e in ('tess', 'easy', 'doctr', 'paddle', 'surya'))}
  FROM hw WHERE coalesce(status, '') <> 'pixel'"""


def document_json(spark, d):
    w = slim_rows(spark, d)
    j = files.document_rows(w, table(spark, d, "pages_meta"), table(spark, d, "scan_files"))
    return j.select("file_id", "page", "total_words", F.get_json_object("json", "$.words[0].text").alias("first_word"), F.get_json_object("json", "$.page_number").cast("bigint").alias("page_number"))


_JSON = f"""WITH {SW} SELECT file_id, page, count(*) AS total_words, arg_min(text, word_id) AS first_word, page AS page_number FROM sw GROUP BY file_id, page"""


def histograms(spark, d):
    """Words by status, source and page rotation."""
    return harmonized_rows(spark, d).groupBy("status", "source", "rotation").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("file_id", "page").alias("pages"))


def page_summary(spark, d):
    w = harmonized_rows(spark, d)
    return w.groupBy("file_id", "page").agg(F.count(F.lit(1)).alias("words"), F.min_by("rotation", "word_id").alias("rotation"), F.round(F.avg("conf"), 9).alias("mean_conf"), F.sort_array(F.collect_set("status")).alias("statuses")).withColumn("statuses", F.array_join("statuses", ","))


def engines_present(spark, d):
    """Which engines there are, in one spelling."""
    return engine_rows(spark, d).groupBy("engine").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("file_id", "page").alias("pages"))


def document_listing(spark, d):
    """The scanned documents, with whether words of them are there."""
    s = table(spark, d, "scan_files").groupBy("file_id").agg(F.max("filename").alias("filename"), F.max("n_pages").alias("n_pages"))
    have = table(spark, d, "harmonized_words").select("file_id").union(table(spark, d, "words_slim").select("file_id")).distinct().withColumn("has_words", F.lit(True))
    return s.join(have, "file_id", "left").withColumn("has_words", F.coalesce("has_words", F.lit(False)))


def vocabulary_sets(spark, d):
    """How many lower-case words two tables share and have alone."""
    a = harmonized_rows(spark, d).select(F.lower("text").alias("t")).where("t <> ''").distinct()
    b = slim_rows(spark, d).select(F.lower("text").alias("t")).where("t <> ''").distinct()
    parts = {"both": a.intersect(b), "first_only": a.exceptAll(b), "second_only": b.exceptAll(a), "either": a.union(b).distinct()}
    out = None
    for k, p in parts.items():
        one = p.agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("words"))
        out = one if out is None else out.unionByName(one)
    return out


_SETS = f"""WITH {HW}, {SW}, a AS (SELECT DISTINCT lower(text) AS t FROM hw WHERE text <> ''), b AS (SELECT DISTINCT lower(text) AS t FROM sw WHERE text <> '')
SELECT 'both' AS part, count(*) AS words FROM (SELECT t FROM a INTERSECT SELECT t FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT t FROM a EXCEPT SELECT t FROM b)
UNION ALL SELECT 'second_only', count(*) FROM (SELECT t FROM b EXCEPT SELECT t FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT t FROM a UNION SELECT t FROM b)"""


def position_numbers(spark, d):
    return files.numbered(slim_rows(spark, d)).select("word_id", "number")


def top_words(spark, d):
    """The ten commonest words of the slim table; ties by the word."""
    return slim_rows(spark, d).where("text <> ''").groupBy(F.lower("text").alias("word")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(10)


def export_upright(spark, d):
    """Boxes with the origin at the bottom of the page."""
    p = table(spark, d, "pages_meta").groupBy("file_id", "page").agg(F.max("height").alias("h"))
    return files.upright(slim_rows(spark, d).join(p, ["file_id", "page"]), F.col("h")).select("word_id", *[r6(F.col(c), c) for c in BOX])


def source_letters(spark, d):
    """The letters of the engines that read a word at all, in voting order."""
    read = F.array_compact(F.array(*[F.when(F.col(f"{c}_text") != "", e) for c, e in (("tess", "tesseract"), ("easy", "easyocr"), ("paddle", "paddleocr"), ("doctr", "doctr"), ("surya", "surya"))]))
    return harmonized_rows(spark, d).select("word_id", H.source_letters(read).alias("letters"), H.status_of(F.col("conf")).alias("status"), H.solo_status(F.col("conf"), F.size(read) > 1).alias("solo_status"))


_ROT = {"x0": ("x0", "w - y1", "w - x1", "y0"), "y0": ("y0", "x0", "h - y1", "h - x1"), "x1": ("x1", "w - y0", "w - x0", "y1"), "y1": ("y1", "x1", "h - y0", "h - x0")}
_PM = "pm AS (SELECT file_id, page, max(width) AS w, max(height) AS h FROM pages_meta GROUP BY file_id, page)"
QUERIES = {
    f.__name__: f
    for f in (
        bbox_geometry, point_containment, bbox_pairs, rotate_bbox, scale_px_to_pt, clamp_confidence, scan_scaled, scan_polygons, line_split_width, line_split_letters, char_islands, ctc_decode, tokenize_words, word_at_position,
        text_measures, garbage_text, concatenated, engine_distances, entity_tag, entity_stats, redaction_drawlist, redaction_preview, redaction_boxes, triage_stats, region_kinds, missed_regions, csv_harmonized, document_json,
        histograms, page_summary, engines_present, document_listing, vocabulary_sets, position_numbers, top_words, export_upright, source_letters,
    )
} | {f"triage_{level}": _triage(level) for level in Q.LEVELS}
ORACLE = {
    "bbox_geometry": f"WITH {HW} SELECT word_id, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS center_x, round((y0 + y1) / 2, 6) AS center_y FROM hw",
    "point_containment": f"WITH {HW}, m AS (SELECT file_id, page, (min(x0) + max(x1)) / 2 AS mx, (min(y0) + max(y1)) / 2 AS my FROM hw GROUP BY ALL) SELECT word_id, mx BETWEEN x0 AND x1 AND my BETWEEN y0 AND y1 AS inside FROM hw JOIN m USING (file_id, page)",
    "bbox_pairs": _PAIRS,
    "rotate_bbox": f"WITH {HW}, {_PM} SELECT word_id, rotation, " + ", ".join(f"round(CASE rotation WHEN 0 THEN {a} WHEN 90 THEN {b} WHEN 180 THEN {c} ELSE {e} END, 6) AS {k}" for k, (a, b, c, e) in _ROT.items()) + " FROM hw JOIN pm USING (file_id, page)",
    "scale_px_to_pt": f"WITH {SW} SELECT word_id, " + ", ".join(f"round({c} * (72.0::double / 300), 6) AS {c}" for c in BOX) + " FROM sw",
    "clamp_confidence": f"WITH {EW} SELECT word_id, round(greatest(0, least(100, confidence + CASE engine WHEN 'doctr' THEN 12 WHEN 'tesseract' THEN -20 ELSE 0 END)), 6) AS confidence FROM ew",
    "scan_scaled": f"WITH {EW} SELECT word_id, trim(text) AS text, " + ", ".join(f"round({c} * 0.24::double, 6) AS {c}" for c in BOX) + ", confidence FROM ew WHERE trim(text) <> '' AND confidence >= 0",
    "scan_polygons": f"WITH {EW} SELECT word_id, round(x0 - 1, 6) AS x0, round(least(y0, y1), 6) AS y0, round(greatest(x1, x0), 6) AS x1, round(greatest(y1, y0) + 2, 6) AS y1 FROM ew",
    "line_split_width": _SPLIT_WIDTH,
    "line_split_letters": _SPLIT_LETTERS,
    "tokenize_words": "SELECT doc_id, coalesce(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')), 0)::bigint AS words FROM documents",
    "word_at_position": _WORD_AT,
    "text_measures": _TEXT,
    "garbage_text": _GARBAGE,
    "concatenated": _CONCAT,
    "entity_tag": f"WITH {_TAGGED} SELECT word_id, entity, entity <> '' AS redact FROM tagged",
    "entity_stats": f"WITH {_TAGGED} SELECT count(*) AS total, count(*) FILTER (entity <> '') AS redacted, count(*) FILTER (entity = 'NAME') AS n_name, count(*) FILTER (entity = 'DATE') AS n_date, count(*) FILTER (entity = 'CODE') AS n_code FROM tagged",
    "redaction_drawlist": f"WITH {_TAGGED} SELECT word_id, page, round(x0 - 2, 6) AS x0, round(y0 - 2, 6) AS y0, round(x1 + 2, 6) AS x1, round(y1 + 2, 6) AS y1, 'fill' AS mode, '#000000' AS colour FROM tagged WHERE entity <> ''",
    "redaction_preview": f"WITH {_TAGGED} SELECT word_id, 'outline' AS mode, CASE entity WHEN 'NAME' THEN '#FF6B6B' WHEN 'DATE' THEN '#4ECDC4' ELSE '#FFE66D' END AS colour FROM tagged WHERE entity <> ''",
    "redaction_boxes": f"WITH {_TAGGED} SELECT file_id, page, count(*) AS n, min(word_id) AS first_id FROM tagged WHERE entity <> '' GROUP BY file_id, page",
    **{f"triage_{level}": _triage_sql(level) for level in Q.LEVELS},
    "triage_stats": f"WITH {SW}, t AS (SELECT *, (length(trim(text)) >= 1 AND confidence >= 20 AND (y1 - y0 <= 0 OR (x1 - x0) / (y1 - y0) <= 40) AND (x1 - x0) * (y1 - y0) >= 6 AND NOT (regexp_matches(text, '^[[:punct:]\\s]*$') AND confidence < 40)) AS ok FROM sw) SELECT count(*) AS words, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS removed, count(*) FILTER (NOT ok AND confidence < 30) AS low_confidence, count(*) FILTER (NOT ok AND regexp_matches(text, '^[[:punct:]\\s]*$')) AS punctuation, count(*) FILTER (NOT ok AND (x1 - x0) * (y1 - y0) < 10) AS tiny FROM t",
    "region_kinds": f"WITH {HW}, s AS (SELECT word_id, x1 - x0 AS w, y1 - y0 AS h FROM hw) SELECT word_id, {_KIND} AS kind FROM s",
    "missed_regions": _MISSED,
    "csv_harmonized": _CSV,
    "document_json": _JSON,
    "histograms": f"WITH {HW} SELECT status, source, rotation, count(*) AS words, count(DISTINCT (file_id, page)) AS pages FROM hw GROUP BY ALL",
    "page_summary": f"WITH {HW} SELECT file_id, page, count(*) AS words, arg_min(rotation, word_id) AS rotation, round(avg(conf), 9) AS mean_conf, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM hw GROUP BY file_id, page",
    "engines_present": f"WITH {EW} SELECT engine, count(*) AS words, count(DISTINCT (file_id, page)) AS pages FROM ew GROUP BY engine",
    "document_listing": "WITH have AS (SELECT file_id FROM harmonized_words UNION SELECT file_id FROM words_slim) SELECT file_id, max(filename) AS filename, max(n_pages) AS n_pages, file_id IN (SELECT file_id FROM have) AS has_words FROM scan_files GROUP BY file_id",
    "vocabulary_sets": _SETS,
    "position_numbers": f"WITH {SW} SELECT word_id, row_number() OVER (PARTITION BY file_id ORDER BY page, y0, x0, word_id) - 1 AS number FROM sw",
    "top_words": f"WITH {SW} SELECT lower(text) AS word, count(*) AS n FROM sw WHERE text <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 10",
    "export_upright": f"WITH {SW}, {_PM} SELECT word_id, round(x0, 6) AS x0, round(h - y1, 6) AS y0, round(x1, 6) AS x1, round(h - y0, 6) AS y1 FROM sw JOIN pm USING (file_id, page)",
    "engine_distances": f"WITH {HW} SELECT word_id, " + ", ".join(f"(CASE WHEN coalesce({e}_text, '') = '' THEN -1 ELSE {lev('text', f'{e}_text')} END)::bigint AS dist_{e}" for e in ("tess", "easy", "doctr", "paddle", "surya")) + " FROM hw",
    "source_letters": f"""WITH {HW}, s AS (SELECT word_id, conf, concat(CASE WHEN tess_text <> '' THEN 'T' END, CASE WHEN easy_text <> '' THEN 'E' END, CASE WHEN paddle_text <> '' THEN 'P' END, CASE WHEN doctr_text <> '' THEN 'D' END, CASE WHEN surya_text <> '' THEN 'S' END) AS letters FROM hw)
      SELECT word_id, letters, CASE WHEN conf >= 60 THEN 'word' WHEN conf >= 20 THEN 'low_conf' ELSE 'pixel' END AS status, CASE WHEN conf >= 98 OR (conf >= 92 AND length(letters) > 1) THEN 'secondary_only' WHEN conf >= 20 THEN 'low_conf' ELSE 'pixel' END AS solo_status FROM s""",
    "char_islands": f"""WITH {SW}, c AS (SELECT word_id AS line_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, x0, y0, y1, (x1 - x0) / length(text) AS cw, confidence / 100 AS conf FROM sw WHERE text <> ''),
      g AS (SELECT *, sum(CASE WHEN regexp_matches(ch, '^\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY pos) AS w FROM c), k AS (SELECT line_id, w, string_agg(ch, '' ORDER BY pos) AS text, min(x0 + pos * cw) AS x0, min(y0) AS y0, max(x0 + (pos + 1) * cw) AS x1, max(y1) AS y1, avg(conf) * 100 AS confidence FROM g WHERE NOT regexp_matches(ch, '^\\s*$') GROUP BY line_id, w)
      SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY w) - 1 AS word_no, text, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(confidence, 6) AS confidence FROM k""",
    "ctc_decode": f"WITH {SW} SELECT word_id AS id, text, round(greatest(confidence / 100, 1e-10), 6) AS confidence FROM sw WHERE text <> ''",
}

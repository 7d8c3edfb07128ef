"""Queries on files and answers, the compact preset, pictures and regions, jobs and settings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafspan import config
from leafspan.functions import sql as functions
from leafspan.functions import text as X
from leafspan.operators import compact as C
from leafspan.operators import entities as E
from leafspan.operators import fusion as V
from leafspan.operators import harmonize as H
from leafspan.operators import layout as L
from leafspan.operators import quality as Q
from leafspan.operators import sanitize as S
from leafspan.operators.matching import PAGE
from leafspan.plans import pages as P
from leafspan.plans import sql
from leafspan.plans import words as W
from leafspan.plans.base import BOX, EW, HW, SW, core, engine_rows, harmonized_rows, slim_rows
from leafspan.session import shared_folder
from leafspan.sources import files, scans, table
from leafspan.streaming.words import job_table, run_jobs

r6 = lambda c, name: F.round(c, 6).alias(name)


def _file(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- files -----------------------------------------------------------------------------------------------------------


def csv_words(spark, d):
    """The slim words written as CSV and read back."""
    path = _file(spark, "words")
    files.write(slim_rows(spark, d).select("page", "word_id", "text", *BOX, "engine", F.col("confidence").alias("ocr_confidence")), path)
    return files.read_words(spark, path).select("page", "word_id", "text", *BOX, "engine", "ocr_confidence")


def csv_harmonized_read(spark, d):
    """The harmonised words written as CSV and read back; blanks take their defaults."""
    path = _file(spark, "harmonized")
    files.write(files.harmonized_rows(harmonized_rows(spark, d)), path)
    return files.read_harmonized(spark, path)


def json_pages(spark, d):
    """The pages written as JSON and read back: the words of each."""
    path = _file(spark, "pages")
    files.write(files.document_rows(slim_rows(spark, d), table(spark, d, "pages_meta"), table(spark, d, "scan_files")), path, "json")
    body = F.from_json("json", "page_number bigint, words array<struct<word_id:bigint,text:string>>")
    return spark.read.schema("file_id bigint, page bigint, json string").json(path).select("file_id", body.alias("b")).select("file_id", F.explode("b.words").alias("w")).select("file_id", "w.word_id", "w.text")


def csv_redacted(spark, d):
    """The words with entity and redact written as CSV, and the boxes to be blackened read back, by page."""
    path = _file(spark, "redacted")
    files.write(files.redacted_rows(W._tagged(spark, d)).select("file_id", "page", "word_id", *BOX, "entity", "redact"), path)
    r = files.read_redactions(spark, path, ("file_id", "page"))
    return r.select("file_id", "page", F.size("boxes").cast("bigint").alias("n"), F.get("boxes", F.lit(0))["word_id"].alias("first_id"))


def csv_sanitized(spark, d):
    """The slim words, unsure ones left blank, written with what was made of them, and read back."""
    path = _file(spark, "sanitized")
    r = S.sanitize(slim_rows(spark, d), table(spark, d, "dict_terms"), ranked=False, keep_uncertain=False)
    files.write(r.select("word_id", "status", "sanitized_text", F.format_string("%.4f", "correction_score").alias("correction_score")), path)
    back = spark.read.csv(path, header=True, schema="word_id bigint, status string, sanitized_text string, correction_score string", multiLine=True, escape='"')
    return back.na.fill("", ["sanitized_text"])


def dictionary_scan(spark, d):
    """The terms written as lines of term and frequency and read as a dictionary: two signs and a frequency of 50 or more."""
    path = _file(spark, "dictionary")
    t = table(spark, d, "dict_terms").where("not contains(term, ',') and not startswith(term, '#')")
    t.select(F.concat("term", F.lit(","), F.round(F.col("weight") * 100).cast("bigint").cast("string")).alias("value")).write.text(path)
    return files.read_dictionary(spark, path, "all", frequencies=True, min_length=2, min_frequency=100)


def names_scan(spark, d):
    """The places written as lines and read as names."""
    path = _file(spark, "names")
    table(spark, d, "dict_terms").where("dictionary = 'place'").select(F.col("term").alias("value")).write.text(path)
    return files.read_names(spark, path)


def counts_scan(spark, d):
    """The pairs of neighbours written as lines with their counts, read back and summed over both sides."""
    path = _file(spark, "bigrams")
    two = S.bigrams(slim_rows(spark, d), PAGE, ["word_id"]).where("not w1 rlike '\\\\s' and not w2 rlike '\\\\s' and not startswith(w1, '#')")
    two.select(F.concat_ws("\t", F.concat_ws(" ", "w1", "w2"), F.col("n").cast("string")).alias("value")).write.text(path)
    return S.side_totals(files.read_counts(spark, path, 2))


def word_lists_json(spark, d):
    """How many terms each JSON array of each dictionary has, and the first."""
    j = files.word_list_json(table(spark, d, "dict_terms"))
    a = F.from_json("json", "array<string>")
    return j.select("dictionary", "letter", F.size(a).cast("bigint").alias("n"), F.get(a, F.lit(0)).alias("first"))


def lines_json(spark, d):
    j = files.lines_json(L.reconstruct_lines(P._located(spark, d)))
    return j.select(*PAGE, "line", F.get_json_object("json", "$.line_id").cast("bigint").alias("line_id"), F.get_json_object("json", "$.text").alias("text"), F.round(F.get_json_object("json", "$.bbox.x0").cast("double"), 6).alias("x0"))


def response_json(spark, d):
    j = files.response_rows(slim_rows(spark, d), table(spark, d, "pages_meta"), table(spark, d, "scan_files"))
    return j.select(*PAGE, "total_words", F.get_json_object("json", "$.words[0].bbox.x0").cast("double").alias("x0"), F.get_json_object("json", "$.page_number").cast("bigint").alias("page_number"))


def scan_nested(spark, d):
    """The words of the engine that nests them, put into pages, blocks and lines with shares of the page, and taken out again."""
    w = engine_rows(spark, d).where("trim(text) <> ''")
    word = F.struct(F.col("text").alias("value"), F.array(F.array(F.col("x0") / 512, F.col("y0") / 1024), F.array(F.col("x1") / 512, F.col("y1") / 1024)).alias("geometry"), (F.col("confidence") / 100).alias("confidence"))
    lines = w.groupBy("file_id", "page", "engine", F.floor("y0").alias("_y")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", word.alias("w")))), lambda x: x["w"]).alias("words"))
    blocks = lines.groupBy("file_id", "page", "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("_y", "words"))), lambda x: F.struct(x["words"].alias("words"))).alias("lines"))
    pages = blocks.groupBy("file_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("engine", "lines"))), lambda x: F.struct(x["lines"].alias("lines"))).alias("blocks")).withColumn("width", F.lit(512.0)).withColumn("height", F.lit(1024.0))
    return scans.nested_words(pages).select(*PAGE, "text", *[r6(F.col(c), c) for c in BOX], r6(F.col("confidence"), "confidence"))


# -- compact preset --------------------------------------------------------------------------------------------------


def plain_vote(spark, d):
    """The readings of every harmonised word, with their order as confidence, under the compact vote."""
    b = P._readings(spark, d).withColumn("ord", F.array_position(F.array(*[F.lit(e) for e in P._READINGS.values()]), F.col("engine"))).withColumn("confidence", 100.0 - 10 * F.col("ord") + F.pmod("word_id", F.lit(7)))
    return C.best_text(b.withColumnRenamed("reading", "_r").drop("text").withColumnRenamed("_r", "text"), "word_id")


def sequential_dedup(spark, d):
    """The words of all engines of a page of which no kept one before is a duplicate."""
    return C.deduplicated(engine_rows(spark, d)).select("word_id", "engine")


def band_lines(spark, d):
    return C.lines_by_band(L.reading_order(P._located(spark, d), L.COMPACT)).select("word_id", "line")


def height_lines(spark, d):
    return C.lines_by_height(P._located(spark, d)).select("word_id", "line")


def tolerant_order(spark, d):
    return C.tolerant_order(P._located(spark, d)).select("word_id", "position")


def first_letter_fuzzy(spark, d):
    q = slim_rows(spark, d).select(F.lower(X.core_of(F.col("text"))).alias("query")).where("query <> ''").distinct()
    return C.first_letter_pairs(q, table(spark, d, "dict_terms"), 2)


def visible_words(spark, d):
    """Words that a viewer shows with two engines visible and entities highlighted."""
    w = W._tagged(spark, d)
    read = F.array_compact(F.array(*[F.when(F.col(f"{c}_text") != "", F.lit(e)) for c, e in P._READINGS.items()]))
    return w.where(C.shown(read, ["paddleocr", "easyocr"], entity=F.col("entity"), entities=True)).select("word_id")


def source_names(spark, d):
    return harmonized_rows(spark, d).select("word_id", C.source_names(F.col("source")).alias("names"))


def escaped_text(spark, d):
    return slim_rows(spark, d).select("word_id", C.escaped(F.col("text")).alias("html"))


def percent_text(spark, d):
    """Confidences as a viewer writes them: a share with two decimals and a number with four."""
    c = F.col("confidence")
    return slim_rows(spark, d).select("word_id", F.concat(F.format_string("%.2f", F.round(c, 2)), F.lit("%")).alias("share"), F.format_string("%.4f", F.round(c / 100, 4)).alias("number"))


def sanitize_evaluation(spark, d):
    """What the vote makes of every engine's reading, against the reading of the most trusted engine."""
    w = harmonized_rows(spark, d).where("surya_text <> ''")
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.col(f"{c}_text").alias("original_text")) for c, e in P._READINGS.items() if e != "surya"])).alias("r")
    r = w.select(F.col("text").alias("sanitized_text"), F.col("surya_text").alias("truth"), each).select("sanitized_text", "truth", "r.*").where("original_text <> ''")
    return S.sanitize_evaluation(r, by=["engine"])


def ranking_factors(spark, d):
    return S.ranking_factors(slim_rows(spark, d), table(spark, d, "dict_terms"))


def page_words(spark, d):
    """The words of the first page of every document: the filter on page reaches the scan."""
    return harmonized_rows(spark, d).where("page = 0").select("file_id", "word_id")


# -- regions and pictures --------------------------------------------------------------------------------------------


def _regions(spark, d):
    """Pixel rows, unsure words, and the rules around every tenth word (a line below and a bar beside it) as candidate regions, and the sure words."""
    w = harmonized_rows(spark, d).select(*PAGE, "word_id", *BOX, "status", "conf")
    some = w.where("word_id % 10 = 0 and status <> 'pixel'")
    line = some.select(*PAGE, (-2 * F.col("word_id")).alias("word_id"), (F.col("x0") - 60).alias("x0"), (F.col("y1") + 1).alias("y0"), (F.col("x0") + 90).alias("x1"), (F.col("y1") + 3).alias("y1"))
    bar = some.select(*PAGE, (-2 * F.col("word_id") - 1).alias("word_id"), (F.col("x1") + 1).alias("x0"), (F.col("y0") - 40).alias("y0"), (F.col("x1") + 4).alias("x1"), (F.col("y0") + 40).alias("y1"))
    region = w.where("status = 'pixel' or conf < 60").select(*PAGE, "word_id", *BOX)
    return region.unionByName(line).unionByName(bar), w.where("status <> 'pixel' and conf >= 60").select(*PAGE, *BOX)


def missed_content(spark, d):
    r, e = _regions(spark, d)
    return Q.missed_content(r, e, PAGE, "word_id").select("word_id", "kind")


def missed_content_compact(spark, d):
    """Text regions first, and no region over an earlier one of its own kind."""
    r, e = _regions(spark, d)
    return Q.missed_content(r, e, PAGE, "word_id", ("text", *Q.PASSES), block_own=True).select("word_id", "kind")


_REGIONS = f"""{HW}, sm AS (SELECT * FROM hw WHERE word_id % 10 = 0 AND status <> 'pixel'), rg AS (SELECT file_id, page, word_id, x0, y0, x1, y1 FROM hw WHERE status = 'pixel' OR conf < 60 UNION ALL SELECT file_id, page, -2 * word_id, x0 - 60, y1 + 1, x0 + 90, y1 + 3 FROM sm UNION ALL SELECT file_id, page, -2 * word_id - 1, x1 + 1, y0 - 40, x1 + 4, y0 + 40 FROM sm),
kd AS (SELECT * FROM (SELECT *, {W._KIND} AS kind FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM rg))), ex AS (SELECT file_id, page, x0, y0, x1, y1 FROM hw WHERE status <> 'pixel' AND conf >= 60)"""


def _chain(kinds: tuple[str, ...]) -> str:
    """One step per kind: what overlaps neither the words nor what an earlier step found."""
    out, blocks = "", ["ex"]
    for i, k in enumerate(kinds):
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {b} r WHERE {sql.ON_PAGE} AND ({sql.iou()} > 0.1 OR ((l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1)))" for b in blocks)
        out += f", f{i} AS (SELECT * FROM kd l WHERE kind = '{k}' AND {free})"
        blocks.append(f"f{i}")
    return out + " " + " UNION ALL ".join(f"SELECT word_id, kind FROM f{i}" for i in range(len(kinds)))


def _grid(spark, d):
    """Every page as a picture of 16 by 16 values: how many words have their center in a cell, up to 255."""
    w = harmonized_rows(spark, d)
    cell = lambda a, size: F.greatest(F.lit(0), F.least(F.lit(15), F.floor((F.col(f"{a}0") + F.col(f"{a}1")) / 2 / size * 16).cast("int")))
    n = w.groupBy(*PAGE, cell("y", 792.0).alias("row"), cell("x", 612.0).alias("col")).agg(F.least(F.lit(255.0), 40.0 * F.count(F.lit(1))).alias("v"))
    all_ = w.select(*PAGE).distinct().select(*PAGE, F.explode(F.sequence(F.lit(0), F.lit(15))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("col"))
    return all_.join(n, [*PAGE, "row", "col"], "left").select(*PAGE, "row", "col", F.coalesce("v", F.lit(0.0)).alias("value"))


def picture_levels(spark, d):
    """Sharpness, contrast and the level of preparation of every page's picture."""
    s = Q.raster_statistics(_grid(spark, d), PAGE)
    return s.select(*PAGE, r6(F.col("sharpness"), "sharpness"), r6(F.col("contrast"), "contrast"), Q.preparation_level(F.col("sharpness"), F.col("contrast")).alias("level"))


_LEVELS = f"""WITH {HW}, c AS (SELECT file_id, page, greatest(0, least(15, floor((y0 + y1) / 2 / 792 * 16)))::int AS r, greatest(0, least(15, floor((x0 + x1) / 2 / 612 * 16)))::int AS k FROM hw), n AS (SELECT file_id, page, r, k, least(255, 40 * count(*))::double AS v FROM c GROUP BY ALL),
g AS (SELECT p.file_id, p.page, r.range AS r, k.range AS k, coalesce(v, 0) AS v FROM (SELECT DISTINCT file_id, page FROM hw) p, range(16) r, range(16) k LEFT JOIN n ON n.file_id = p.file_id AND n.page = p.page AND n.r = r.range AND n.k = k.range),
l AS (SELECT *, coalesce(lag(v) OVER x, lead(v) OVER x) + coalesce(lead(v) OVER x, lag(v) OVER x) + coalesce(lag(v) OVER y, lead(v) OVER y) + coalesce(lead(v) OVER y, lag(v) OVER y) - 4 * v AS a FROM g WINDOW x AS (PARTITION BY file_id, page, r ORDER BY k), y AS (PARTITION BY file_id, page, k ORDER BY r)),
s AS (SELECT file_id, page, var_pop(a) AS sharpness, stddev_pop(v) AS contrast FROM l GROUP BY ALL)
SELECT file_id, page, round(sharpness, 6) AS sharpness, round(contrast, 6) AS contrast, CASE WHEN sharpness > 500 AND contrast > 50 THEN 'light' WHEN sharpness > 100 AND contrast > 30 THEN 'standard' WHEN sharpness > 50 THEN 'aggressive' ELSE 'degraded' END AS level FROM s"""
_ANGLES = {"tesseract": 0, "easyocr": 90, "doctr": 180, "surya": 270}


def orientation_vote(spark, d):
    """The readings of a page's four engines as if each had read it at another angle."""
    angle = F.create_map(*[F.lit(x) for k, v in _ANGLES.items() for x in (k, v)])[F.col("engine")]
    return Q.best_orientation(engine_rows(spark, d).select(*PAGE, angle.alias("angle"), "confidence"), PAGE)


def anchor_clusters(spark, d):
    """The cluster in which every unsure word would be looked for, by the middle of its box."""
    w = P._located(spark, d)
    c = L.clusters(w).select(*PAGE, "cluster", *[f"c_{b}" for b in BOX]).distinct()
    p = w.where("confidence < 90").select(*PAGE, "word_id", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    return V.cluster_of(p, c, ["word_id"]).select("word_id", "cluster")


def layout_diagnostics(spark, d):
    """How the compact layout came about: clusters, bands and rows of every page, and its edges by rule."""
    w = P._located(spark, d)
    order = L.reading_order(w, L.COMPACT).groupBy(*PAGE).agg(F.countDistinct("cluster").alias("clusters"), F.countDistinct("band").alias("bands"), F.countDistinct("cluster", "row").alias("rows"))
    rules = L.cluster_edges(w, L.COMPACT).groupBy(*PAGE).agg(*[F.count_if(F.col("rule") == k).alias(f"rule{k}") for k in (1, 2, 3)])
    return order.join(rules, PAGE, "left").na.fill(0)


# -- jobs and settings -----------------------------------------------------------------------------------------------


def job_states(spark, d):
    """The job table after all files have been tagged batch by batch."""
    out = _file(spark, "jobs")
    run_jobs(P._slim_stream(spark, d), out, f"{out}-state", lambda rows: rows.withColumn("entity", E.entity_of(F.col("text"), F.lit(False)))).awaitTermination()
    return job_table(spark, out)


def incremental_index(spark, d):
    """How often every term is in every document, brought up to date batch by batch."""

    def count(rows):
        return rows.select("file_id", F.lower(X.core_of(F.col("text"))).alias("term")).where("term <> ''").groupBy("file_id", "term").agg(F.count(F.lit(1)).alias("n"))

    return P._counted(P._slim_stream(spark, d), count, "incremental_index")


def settings(spark, d):
    """Every setting with its default, after two were overridden."""
    s = config.load(overrides={"harmonize": {"word_conf": 65, "engines": {"kraken": {"enabled": True}}}})
    return spark.createDataFrame(config.describe(s), "path string, kind string, preset string, value string")


def sql_functions(spark, d):
    """Measures of neighbouring words by the SQL functions of the session."""
    functions.register(spark)
    o = Window.partitionBy(*PAGE).orderBy("word_id")
    w = harmonized_rows(spark, d).where("text <> ''").select("word_id", "text", *BOX, F.lead("text").over(o).alias("t2"), *[F.lead(b).over(o).alias(f"b{b}") for b in BOX]).where("t2 is not null")
    pair = ", ".join([*BOX, *[f"b{b}" for b in BOX]])
    return w.selectExpr("word_id", f"round(box_iou({pair}), 6) AS iou", f"round(box_gap_x({pair}), 6) AS gap", "word_core(text) AS core", "round(text_similarity(word_core(text), word_core(text)), 6) AS own", "round(digit_share(text), 6) AS digits")


QUERIES = {
    f.__name__: f
    for f in (
        csv_words, csv_harmonized_read, json_pages, csv_redacted, csv_sanitized, dictionary_scan, names_scan, counts_scan, word_lists_json, lines_json, response_json, scan_nested,
        plain_vote, sequential_dedup, band_lines, height_lines, tolerant_order, first_letter_fuzzy, visible_words, source_names, escaped_text, percent_text, sanitize_evaluation, ranking_factors, page_words,
        missed_content, missed_content_compact, picture_levels, orientation_vote, anchor_clusters, layout_diagnostics, job_states, incremental_index, settings, sql_functions,
    )
}
_TWO = P._TWO
_LOWER = f"lower({core('text')})"
_ORD = ", ".join(f"'{e}'" for e in P._READINGS.values())
_READ = P._READ
ORACLE = {
    "csv_words": f"WITH {SW} SELECT page, word_id, text, x0, y0, x1, y1, engine, confidence AS ocr_confidence FROM sw",
    "csv_harmonized_read": f"WITH {HW} SELECT word_id, page, {', '.join(f'round({b}, 2) AS {b}' for b in BOX)}, text, coalesce(status, '') AS status, source, round(conf, 1) AS conf, coalesce(rotation, 0) AS rotation, {', '.join(f'coalesce({e}_text, {chr(39) * 2}) AS {e}' for e in ('tess', 'easy', 'doctr', 'paddle', 'surya'))} FROM hw",
    "json_pages": f"WITH {SW} SELECT file_id, word_id, text FROM sw",
    "csv_redacted": f"WITH {W._TAGGED} SELECT file_id, page, count(*) AS n, min(word_id) AS first_id FROM tagged WHERE entity <> '' GROUP BY file_id, page",
    "csv_sanitized": f"SELECT word_id, status, CASE WHEN status = 'uncertain' THEN '' ELSE sanitized_text END AS sanitized_text, printf('%.4f', correction_score) AS correction_score FROM ({P._UNRANKED})",
    "dictionary_scan": "SELECT DISTINCT 'all' AS dictionary, term, lower(term) AS term_lower FROM (SELECT trim(term) AS term, round(weight * 100)::bigint AS n FROM dict_terms WHERE NOT contains(term, ',') AND NOT starts_with(term, '#')) WHERE length(term) >= 2 AND n >= 100",
    "names_scan": "SELECT DISTINCT lower(trim(term)) AS name FROM dict_terms WHERE dictionary = 'place' AND trim(term) <> ''",
    "counts_scan": f"WITH {_TWO}, p AS (SELECT * FROM k WHERE NOT regexp_matches(w1, '[ \\t\\n\\r\\f]') AND NOT regexp_matches(w2, '[ \\t\\n\\r\\f]') AND NOT starts_with(w1, '#')) SELECT word, sum(n)::bigint AS n FROM (SELECT w1 AS word, n FROM p UNION ALL SELECT w2, n FROM p) GROUP BY word",
    "word_lists_json": "SELECT dictionary, lower(substr(term, 1, 1)) AS letter, count(DISTINCT term) AS n, min(term) AS first FROM dict_terms WHERE term IS NOT NULL GROUP BY 1, 2",
    "lines_json": P.ORACLE["reconstruct_lines"].replace("SELECT file_id, page, line, string_agg(word, ' ' ORDER BY n) AS text, count(*) AS n_words, " + ", ".join(f"round(arg_max({b}, n), 6) AS {b}" for b in BOX), "SELECT file_id, page, line, line AS line_id, string_agg(word, ' ' ORDER BY n) AS text, round(arg_max(x0, n), 6) AS x0"),
    "response_json": f"WITH {SW} SELECT file_id, page, any_value(t) AS total_words, arg_min(x0, word_id) AS x0, page AS page_number FROM sw JOIN (SELECT file_id, count(*) AS t FROM sw GROUP BY file_id) USING (file_id) GROUP BY file_id, page",
    "scan_nested": f"WITH {EW} SELECT file_id, page, text, {', '.join(f'round({b}, 6) AS {b}' for b in BOX)}, round(confidence, 6) AS confidence FROM ew WHERE trim(text, ' ') <> ''",
    "plain_vote": f"""WITH {HW}, {_READ}, v AS (SELECT word_id, engine, reading, list_position([{_ORD}], engine) AS o, 100 - 10 * list_position([{_ORD}], engine) + word_id % 7 AS c FROM rd),
      g AS (SELECT word_id, lower(trim(reading, ' ')) AS norm, sum(c) + CASE WHEN count(*) > 1 THEN 50 ELSE 0 END AS s, min(o) AS o, count(*) AS n, arg_max(reading, c * 100 - o) AS text, arg_max(engine, c * 100 - o) AS e, max(c) AS c FROM v GROUP BY 1, 2),
      b AS (SELECT *, sum(n) OVER p AS votes, max(c) OVER p AS conf, row_number() OVER (PARTITION BY word_id ORDER BY s DESC, o) AS k FROM g WINDOW p AS (PARTITION BY word_id))
      SELECT word_id, text, conf::double AS confidence, conf < 80 AS low_confidence, CASE WHEN votes = 1 THEN 'only ' || e WHEN n > 1 THEN 'agreement' ELSE 'surer: ' || e END AS reason FROM b WHERE k = 1""",
    "band_lines": f"{sql.clustered(L.COMPACT)}{sql.ORDER} SELECT word_id, sum(CASE WHEN band <> pb THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, page ORDER BY position ROWS UNBOUNDED PRECEDING)::bigint AS line FROM (SELECT *, lag(band) OVER (PARTITION BY file_id, page ORDER BY position) AS pb FROM ro)",
    "height_lines": f"""WITH RECURSIVE {sql.LOC}, i AS (SELECT *, row_number() OVER (PARTITION BY file_id, page ORDER BY word_id) AS n FROM w), s AS (SELECT file_id, page, n, word_id, 0::bigint AS line, cy AS at FROM i WHERE n = 1
      UNION ALL SELECT s.file_id, s.page, i.n, i.word_id, CASE WHEN abs(i.cy - s.at) > 20 THEN s.line + 1 ELSE s.line END, CASE WHEN abs(i.cy - s.at) > 20 THEN i.cy ELSE (s.at + i.cy) / 2 END FROM s JOIN i ON i.file_id = s.file_id AND i.page = s.page AND i.n = s.n + 1) SELECT word_id, line FROM s""",
    "tolerant_order": f"WITH {sql.LOC} SELECT word_id, row_number() OVER (PARTITION BY file_id, page ORDER BY floor(y0 / 10), x0, word_id) - 1 AS position FROM w",
    "first_letter_fuzzy": f"""WITH {SW}, c AS (SELECT DISTINCT {_LOWER} AS q FROM sw WHERE {core('text')} <> ''), t AS (SELECT term_lower, term, dictionary, weight, {P._RANK.format('dictionary')} AS r FROM dict_terms WHERE term_lower <> ''),
      p AS (SELECT q, term, dictionary, r, weight, {sql.lev('q', 'term_lower')} AS n, CASE WHEN substr(term_lower, 1, 1) = substr(q, 1, 1) THEN 1 WHEN (substr(term_lower, 1, 1) = substr(q, 2, 1) AND length(q) > 1) OR (unicode(term_lower) = unicode(q) - 1 AND unicode(q) > 97) OR (unicode(term_lower) = unicode(q) + 1 AND unicode(q) < 122) THEN 2 END AS step FROM c JOIN t ON abs(length(q) - length(term_lower)) <= 2),
      m AS (SELECT *, min(step) OVER (PARTITION BY q) AS least, min((r, term)) FILTER (n = 0) OVER (PARTITION BY q) AS ex FROM p WHERE n <= 2 AND step IS NOT NULL QUALIFY step = least), x AS (SELECT *, min((r, term)) FILTER (n = 0) OVER (PARTITION BY q) AS e FROM m)
      SELECT q AS query, term, dictionary, n::bigint AS distance, round(weight * (1 - n / 3), 9) AS score FROM x WHERE e IS NULL OR ((r, term) <= e AND (n > 0 OR (r, term) = e))""",
    "visible_words": f"WITH {W._TAGGED} SELECT word_id FROM tagged WHERE coalesce(paddle_text, '') <> '' OR coalesce(easy_text, '') <> '' OR entity <> ''",
    "source_names": f"WITH {HW} SELECT word_id, CASE WHEN source = '' THEN '-' WHEN source IN ('PX', 'X') THEN 'Pixel Detection' ELSE array_to_string(list_transform(string_split(source, ''), lambda c: CASE c {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in C.SOURCES.items())} ELSE c END), ' + ') END AS names FROM hw",
    "escaped_text": f"WITH {SW} SELECT word_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM sw",
    "percent_text": f"WITH {SW} SELECT word_id, printf('%.2f', round(confidence, 2)) || '%' AS share, printf('%.4f', round(confidence / 100, 4)) AS number FROM sw",
    "sanitize_evaluation": f"""WITH {HW}, r AS ({" UNION ALL ".join(f"SELECT '{e}' AS engine, {c}_text AS o, text AS s, surya_text AS t FROM hw WHERE {c}_text <> '' AND surya_text <> ''" for c, e in P._READINGS.items() if e != 'surya')}),
      n AS (SELECT engine, count(*) AS total, count(*) FILTER (s <> o AND s = t) AS tp, count(*) FILTER (s <> o AND s <> t) AS fp, count(*) FILTER (s = o AND o <> t) AS fn, count(*) FILTER (s = o AND o = t) AS tn FROM r GROUP BY engine), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
      SELECT engine, total, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round((tp + tn) / total, 6) AS accuracy FROM p""",
    "page_words": f"WITH {HW} SELECT file_id, word_id FROM hw WHERE page = 0",
    "missed_content": f"WITH {_REGIONS}{_chain(Q.PASSES)}",
    "picture_levels": _LEVELS,
    "orientation_vote": f"WITH {EW}, a AS (SELECT file_id, page, CASE engine {' '.join(f'WHEN {e!r} THEN {n}' for e, n in _ANGLES.items())} END AS angle, round(avg(confidence), 9) AS c, count(*) AS n FROM ew GROUP BY ALL) SELECT file_id, page, (CASE WHEN max(c) > 0 THEN arg_max(angle, (c, n, -angle)) ELSE 0 END)::bigint AS angle FROM a WHERE angle IS NOT NULL GROUP BY file_id, page",
    "anchor_clusters": f"""{sql.clustered()}, cb AS (SELECT DISTINCT file_id, page, cluster, c_x0, c_y0, c_x1, c_y1 FROM clb), p AS (SELECT word_id, cluster, cx BETWEEN c_x0 - 20 AND c_x1 + 20 AND cy BETWEEN c_y0 - 20 AND c_y1 + 20 AS inside, sqrt(pow(cx - (c_x0 + c_x1) / 2, 2) + pow(cy - (c_y0 + c_y1) / 2, 2)) AS far FROM w JOIN cb ON cb.file_id = w.file_id AND cb.page = w.page WHERE conf < 90)
      SELECT word_id, cluster FROM p QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE far END, cluster) = 1""",
    "layout_diagnostics": f"""{sql.clustered(L.COMPACT)}{sql.ORDER}, o AS (SELECT file_id, page, count(DISTINCT cluster) AS clusters, count(DISTINCT band) AS bands, count(DISTINCT (cluster, "row")) AS rows FROM ro GROUP BY file_id, page), e AS (SELECT file_id, page, count(*) FILTER (rule = 1) AS rule1, count(*) FILTER (rule = 2) AS rule2, count(*) FILTER (rule = 3) AS rule3 FROM ed GROUP BY file_id, page)
      SELECT file_id, page, clusters, bands, rows, coalesce(rule1, 0) AS rule1, coalesce(rule2, 0) AS rule2, coalesce(rule3, 0) AS rule3 FROM o LEFT JOIN e USING (file_id, page)""",
    "job_states": "SELECT file_id, count(*) AS rows, 'completed' AS state, NULL::varchar AS error FROM words_slim GROUP BY file_id",
    "incremental_index": f"SELECT file_id, {_LOWER} AS term, count(*) AS n FROM words_slim WHERE {core('text')} <> '' GROUP BY ALL",
    "sql_functions": f"""WITH {sql.LOC}, l AS (SELECT *, lead(word_id) OVER (PARTITION BY file_id, page ORDER BY word_id) AS nx FROM w) SELECT l.word_id, round({sql.iou()}, 6) AS iou, round(greatest(greatest(l.x0, r.x0) - least(l.x1, r.x1), 0), 6) AS gap, {core('l.text')} AS core, 1.0::double AS own, round(length(regexp_replace(l.text, '[^0-9]', '', 'g')) / length(l.text), 6) AS digits FROM l JOIN w r ON r.word_id = l.nx""",
}

"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from leafspan.operators.fusion import FIRST_LINE, INDENT, LEADING, MARGIN, PAGE_WIDTH, SPACE
from leafspan.operators.layout import Config
from leafspan.plans.base import HW

#: Name -> share of the weight, IoU and center distance of the engines that are matched with the primary.
MATCHED = {"easyocr": (0.3, 12), "paddleocr": (0.3, 12), "doctr": (0.3, 12), "surya": (0.08, 50)}


def chars(t: str) -> str:
    return f"list_transform(range(1, length({t}) + 1), lambda i: substr({t}, i, 1))"


def lev(a: str, b: str) -> str:
    """Edit distance in code points: DuckDB's own counts bytes, so it serves ASCII, and a fold over rows the rest."""
    return f"""(CASE WHEN {a} = {b} THEN 0 WHEN length({a}) = 0 OR length({b}) = 0 THEN length({a}) + length({b}) WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b})
  ELSE list_reduce(list_concat([range(0, length({b}) + 1)], list_transform({chars(a)}, lambda c: [unicode(c)::bigint])), lambda acc, x: list_reduce(list_concat([[acc[1] + 1]], list_transform(range(1, length({b}) + 1), lambda j: [j])),
    lambda r, j: list_append(r, least(r[len(r)] + 1, acc[j[1] + 1] + 1, acc[j[1]] + CASE WHEN unicode(substr({b}, j[1]::int, 1)) = x[1] THEN 0 ELSE 1 END))))[length({b}) + 1] END)"""


def title(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z\\p{{L}}]+|[^A-Za-z\\p{{L}}]+'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '')"


def like_case(target: str, model: str) -> str:
    letters = f"regexp_matches({model}, '\\p{{L}}')"
    return f"CASE WHEN {letters} AND upper({model}) = {model} THEN upper({target}) WHEN {letters} AND lower({model}) = {model} THEN lower({target}) WHEN {letters} AND {title(model)} = {model} THEN {title(target)} ELSE {target} END"


def iou(l: str = "l", r: str = "r") -> str:
    ox, oy = (f"(least({l}.{c}1, {r}.{c}1) - greatest({l}.{c}0, {r}.{c}0))" for c in "xy")
    union = f"(({l}.x1 - {l}.x0) * ({l}.y1 - {l}.y0) + ({r}.x1 - {r}.x0) * ({r}.y1 - {r}.y0) - {ox} * {oy})"
    return f"(CASE WHEN {ox} > 0 AND {oy} > 0 AND {union} > 0 THEN {ox} * {oy} / {union} ELSE 0 END)"


#: Same page; centers; vertical distance of centers.
ON_PAGE = "l.file_id = r.file_id AND l.page = r.page"
DY = "abs((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2)"
LOC = f"{HW}, w AS (SELECT file_id, page, word_id, text, conf, x0, y0, x1, y1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM hw WHERE text <> '')"


def thresholds(c: Config = Config()) -> str:
    return f""", g AS (SELECT file_id, page, lead(x0) OVER o - x1 AS gx, lead(y0) OVER o - y1 AS gy FROM w WINDOW o AS (PARTITION BY file_id, page ORDER BY cy, cx, word_id)),
q AS (SELECT file_id, page, quantile_cont(gx, 0.25) FILTER (gx > 0) AS qx, quantile_cont(gy, 0.25) FILTER (gy > 0) AS qy FROM g GROUP BY file_id, page),
thr AS (SELECT file_id, page, CASE WHEN qx IS NULL THEN {c.default_x} ELSE greatest(qx * {c.q1_times}, {c.floor_x}) END AS x_threshold, CASE WHEN qy IS NULL THEN {c.default_y} ELSE greatest(qy * {c.q1_times}, {c.floor_y}) END AS y_threshold FROM q)"""


def fuzz(c: Config = Config()) -> str:
    return f""", pr AS (SELECT l.file_id, l.page, abs(l.cy - r.cy) AS dy FROM w l JOIN w r ON l.file_id = r.file_id AND l.page = r.page AND l.word_id < r.word_id JOIN thr ON thr.file_id = l.file_id AND thr.page = l.page
  WHERE greatest(greatest(l.x0, r.x0) - least(l.x1, r.x1), 0) <= 3 * x_threshold AND greatest(greatest(l.y0, r.y0) - least(l.y1, r.y1), 0) <= 0.5 * least(l.y1 - l.y0, r.y1 - r.y0)),
noise AS (SELECT file_id, page, count(*) AS n, median(dy) AS med, stddev_pop(dy) AS std FROM pr GROUP BY file_id, page), tall AS (SELECT file_id, page, avg(y1 - y0) AS tall FROM w GROUP BY file_id, page),
fuzz AS (SELECT file_id, page, least(CASE WHEN coalesce(n, 0) < 3 THEN {c.fuzz_default} ELSE greatest(med + std, {c.fuzz_times} * std, {c.fuzz_default}) END, {c.fuzz_height} * tall) AS fuzz FROM tall LEFT JOIN noise USING (file_id, page))"""


ROWS = """, rw AS (SELECT w.*, sum(CASE WHEN cy > last + fuzz THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, page ORDER BY cy, word_id ROWS UNBOUNDED PRECEDING) AS "row" FROM
  (SELECT w.*, fuzz, lag(cy) OVER (PARTITION BY w.file_id, w.page ORDER BY cy, word_id) AS last FROM w JOIN fuzz ON w.file_id = fuzz.file_id AND w.page = fuzz.page) w)"""
BOUNDS = """, gp AS (SELECT file_id, page, x0 - lag(x1) OVER o AS gap, (x0 + lag(x1) OVER o) / 2 AS mid FROM rw WINDOW o AS (PARTITION BY file_id, page, "row" ORDER BY x0, word_id)),
bg AS (SELECT file_id, page, mid FROM (SELECT *, median(gap) OVER (PARTITION BY file_id, page) AS m FROM gp WHERE gap > 0) WHERE gap >= 3 * m), bd AS (SELECT file_id, page, count(DISTINCT mid) AS n, min(mid) AS f, max(mid) AS l FROM bg GROUP BY file_id, page)"""


def edges(c: Config = Config()) -> str:
    return f""", cl AS (SELECT w.*, (SELECT count(DISTINCT mid) FROM bg WHERE bg.file_id = w.file_id AND bg.page = w.page AND mid <= w.cx) AS col FROM w),
pe AS (SELECT l.file_id, l.page, l.word_id AS a, r.word_id AS b, l.col = r.col AS same, x_threshold, y_threshold, least(l.x1, r.x1) - greatest(l.x0, r.x0) AS ox, least(l.y1, r.y1) - greatest(l.y0, r.y0) AS oy, least(l.x1 - l.x0, r.x1 - r.x0) AS sx, least(l.y1 - l.y0, r.y1 - r.y0) AS sy
  FROM cl l JOIN cl r ON l.file_id = r.file_id AND l.page = r.page AND l.word_id < r.word_id JOIN thr ON thr.file_id = l.file_id AND thr.page = l.page),
ed AS (SELECT * FROM (SELECT file_id, page, a, b, CASE WHEN CASE WHEN sy > 0 THEN greatest(oy, 0) / sy ELSE 0 END >= {c.y_overlap} AND greatest(-ox, 0) <= {c.same_row_times} * x_threshold THEN CASE WHEN same OR greatest(-ox, 0) <= 2 * x_threshold THEN 1 END
  WHEN same THEN CASE WHEN CASE WHEN sx > 0 THEN greatest(ox, 0) / sx ELSE 0 END >= {c.x_overlap} AND greatest(-oy, 0) <= {c.vertical_times} * y_threshold THEN 2 WHEN greatest(-ox, 0) <= x_threshold AND greatest(-oy, 0) <= y_threshold THEN 3 END END AS rule FROM pe) WHERE rule IS NOT NULL)"""


#: Every word with its component (the least word it can be reached from) and the component's box.
CLUSTERS = """, un AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), reach(id, c) AS (SELECT word_id, word_id FROM w UNION SELECT un.b, reach.c FROM reach JOIN un ON un.a = reach.id AND reach.c < un.b),
comp AS (SELECT id AS word_id, min(c) AS cluster FROM reach GROUP BY id), clb AS (SELECT w.*, cluster, min(x0) OVER p AS c_x0, min(y0) OVER p AS c_y0, max(x1) OVER p AS c_x1, max(y1) OVER p AS c_y1 FROM w JOIN comp USING (word_id) WINDOW p AS (PARTITION BY file_id, page, cluster))"""
ORDER = """, one AS (SELECT DISTINCT file_id, page, cluster, c_x0, c_y0, c_y1 FROM clb), low AS (SELECT one.*, fuzz, max(c_y1) OVER (PARTITION BY one.file_id, one.page ORDER BY c_y0, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM one JOIN fuzz ON one.file_id = fuzz.file_id AND one.page = fuzz.page),
bn AS (SELECT file_id, page, cluster, sum(CASE WHEN c_y0 > low + fuzz THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, page ORDER BY c_y0, cluster ROWS UNBOUNDED PRECEDING) AS band FROM low),
ri AS (SELECT c.*, fuzz, lag(cy) OVER (PARTITION BY c.file_id, c.page, cluster ORDER BY cy, word_id) AS last FROM clb c JOIN fuzz ON c.file_id = fuzz.file_id AND c.page = fuzz.page),
rc AS (SELECT *, sum(CASE WHEN cy > last + fuzz THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, page, cluster ORDER BY cy, word_id ROWS UNBOUNDED PRECEDING) AS rw_no FROM ri),
ro AS (SELECT rc.file_id, rc.page, word_id, rc.cluster, band::bigint AS band, rw_no::bigint AS "row", row_number() OVER (PARTITION BY rc.file_id, rc.page ORDER BY band, c_x0, c_y0, rc.cluster, rw_no, x0, cy, word_id) - 1 AS position FROM rc JOIN bn ON rc.file_id = bn.file_id AND rc.page = bn.page AND rc.cluster = bn.cluster)"""


def clustered(c: Config = Config()) -> str:
    return f"WITH RECURSIVE {LOC}{thresholds(c)}{fuzz(c)}{ROWS}{BOUNDS}{edges(c)}{CLUSTERS}"


SIZES = """, sz AS (SELECT p.file_id, p.page, coalesce(cw, 10) AS char_w, coalesce(ch, 15) AS char_h FROM (SELECT DISTINCT file_id, page FROM w) p LEFT JOIN (SELECT file_id, page, avg((x1 - x0) / length(text)) AS cw, avg(y1 - y0) AS ch FROM w WHERE x1 > x0 AND y1 > y0 GROUP BY file_id, page) a ON a.file_id = p.file_id AND a.page = p.page)"""
#: Fixed place of the first word, and the indented edges of a line, on a page where nothing is known.
LEFT, RIGHT, TOP, LINE, GAP = MARGIN + INDENT, PAGE_WIDTH - MARGIN - INDENT, FIRST_LINE, LEADING, SPACE

"""Pages of words as one row each, with what the neighbouring pages say; the ground of problems 5 and 6.

A page is the unit of work: its size is bounded, whatever the size of its file, and no step groups by file. What a page needs
from others (titles, words across the page break) comes from its two neighbours on either side by an equi-join.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from leafspan.session import cut, spread
from leafspan.sources import table

#: Words whose centers are this near, in points, stand on one line; a footer stands in the last part of the page, below FOOT of its
#: height, with a gap of GAP above it. TALL is the height of pages of which none is known.
LINE, FOOT, GAP, TALL = 6.0, 0.87, 25.0, 792.0
#: Lines of the page before and of the page behind that a page gets to see, whole.
REACH = 3
#: The word tables and the confidences that tell misread words from others; that of a vote hardly does.
SOURCES = {"harmonized_words": None, "words_slim": "ocr_confidence"}
_EDGE = "\"'“”‘’«»„()[]{}<>"
_ROMAN = re.compile(r"^[ivxl1|!]{1,5}$", re.I)
_DATE = re.compile(r"^[0-9OolISZ|]{1,2}/[0-9A-Za-z|]{1,2}/[0-9A-Za-z|]{2,4}$")


@lru_cache(1 << 17)
def clean(text: str) -> str:
    """NFKC, without invisible signs and outer white space."""
    t = unicodedata.normalize("NFKC", text)
    if not t.isascii():
        t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc"))
    return t.strip()


@lru_cache(1 << 17)
def bare(text: str) -> str:
    """Lower case, without quotes, brackets and closing punctuation."""
    return text.lower().strip(_EDGE + ".,;:?!")


@lru_cache(1 << 17)
def near(a: str, b: str, most: int) -> bool:
    """Whether two short strings are within ``most`` edits."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or not most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        low = i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            low = min(low, row[j])
        if low > most:
            return False
    return row[-1] <= most


def alike(a: str, b: str) -> bool:
    return near(a, b, 0 if min(len(a), len(b)) < 3 else 1 if min(len(a), len(b)) < 7 else 2)


class Page(NamedTuple):
    """Words in reading order, cleaned, and the line of each (-1 for words without text)."""

    text: list[str]
    line: list[int]
    lines: list[list[int]]
    foot: bool


def layout(texts: list[str], y0: list[float], y1: list[float], tall: float | None = None) -> Page:
    text, line, lines, at = [clean(t) if t else "" for t in texts], [], [], None
    for i, t in enumerate(text):
        y = ((y0[i] or 0.0) + (y1[i] or 0.0)) / 2
        if not t and not texts[i]:
            line.append(-1)
            continue
        if at is None or abs(y - at) > LINE:
            lines.append([])
            at = y
        lines[-1].append(i)
        line.append(len(lines) - 1)
    mid = [sum((y0[i] or 0.0) + (y1[i] or 0.0) for i in l) / 2 / len(l) for l in lines]
    foot = bool(lines) and mid[-1] > FOOT * (tall or TALL) and (len(lines) == 1 or mid[-1] - mid[-2] > GAP)
    return Page(text, line, lines, foot)


def page_number_words(words: list[str]) -> list[bool]:
    """Which words of a line in the margin belong to a page number: "p. 3", "Page 2 of 4", "3/3", "[1]", "- 2 -", "ii"."""
    out = []
    low = [w.lower().strip(".,;:") for w in words]
    digits = [any(c.isdigit() for c in w) for w in words]
    for i, w in enumerate(low):
        short = bool(re.fullmatch(r"[\[(]?[0-9OolISZ|!:]{1,3}[\])]?", words[i].strip(".,;"))) and (digits[i] or len(w) == 1 or w[0] in "[(")
        ratio = bool(re.fullmatch(r"[0-9a-z|!]{1,3}/[0-9a-z|!]{1,3}", w)) and digits[i]
        roman = bool(_ROMAN.match(w))
        bracket = w[:1] in "[(" and w[-1:] in "])" and len(w) <= 5
        framed = bool(re.fullmatch(r"[-–—‐]\s*\S{1,4}\s*[-–—‐]", w))
        dash = w in ("-", "–", "—", "‐", "~")
        page = (near(w, "page", 1) and len(w) >= 3 and i + 1 < len(low) and len(low[i + 1]) <= 4) or (w == "p" and i + 1 < len(low))
        of = len(w) == 2 and near(w, "of", 1) and 0 < i < len(low) - 1 and (digits[i - 1] or digits[i + 1])
        odd = len(w) <= 2 and len(words) <= 5 and not w.isalpha()
        dashed = i > 0 and i + 1 < len(low) and low[i - 1] in ("-", "–", "—") and low[i + 1] in ("-", "–", "—") and len(w) <= 3
        behind = 0 < i and len(w) <= 2 and (near(low[i - 1], "page", 1) and len(low[i - 1]) >= 3 or low[i - 1] == "p")
        out.append(short or ratio or roman or bracket or page or of or odd or dashed or behind or framed or dash)
    return out


def title_words(words: list[str]) -> list[str]:
    """The words of a margin line that are neither dates nor part of a page number, sorted."""
    number = page_number_words(words)
    return sorted(bare(w) for w, n in zip(words, number) if not n and not _DATE.match(w.strip(".,;")) and bare(w))


def same_title(a: list[str], b: list[str]) -> bool:
    """Whether most words of two lines are alike, one to one."""
    if not a or not b:
        return False
    left, hits = list(b), 0
    for w in a:
        for i, v in enumerate(left):
            if alike(w, v):
                hits += 1
                del left[i]
                break
    return hits >= 2 and hits >= 0.6 * max(len(a), len(b)) or (hits == len(a) == len(b))


def outline(p: Page) -> dict:
    """Title candidates of a page, from its first two lines."""
    words = [[p.text[i] for i in l] for l in p.lines]
    body = list(range(len(words) - p.foot))
    top = words[body[0]] if body else []
    second = words[body[1]] if len(body) > 1 else []
    return {"top": title_words(top), "second": title_words(second), "width": len(top), "dated": any(_DATE.match(w.strip(".,;")) for w in top), "numbered": bool(top) and any(page_number_words(top)[k] for k in (0, -1))}


def is_header(own: dict, page: int, around: dict[int, dict]) -> bool:
    """Whether the top line of a page is a running header: on the first page when the heading follows it once more, on
    others when it is like the top lines (or the first page's heading) around it."""
    top = own["top"]
    if not top:
        return own["width"] > 0 and own["numbered"]
    if page == 0:
        if same_title(top, own["second"]):
            return True
        return (own["dated"] or own["numbered"]) and any(same_title(top, n["top"]) for n in around.values()) and own["width"] <= 8
    seen = [n["top"] for n in around.values() if n["width"] <= 8] + [around[-page]["second"] for _ in (0,) if -page in around]
    if any(same_title(top, s) for s in seen):
        return True
    # the other header of a file with two: as short, and closed by the same kind of word
    return len(top) <= 3 and own["width"] <= 4 and any(alike(w, v) and len(w) > 3 for s in seen if len(s) <= 4 for v in s for w in top)


_ARROW_OUTLINE = pa.struct([("top", pa.list_(pa.string())), ("second", pa.list_(pa.string())), ("width", pa.int32()), ("dated", pa.bool_()), ("numbered", pa.bool_())])
_ARROW_EDGES = pa.struct([("outline", _ARROW_OUTLINE), ("head", pa.list_(pa.list_(pa.string()))), ("tail", pa.list_(pa.list_(pa.string())))])


@F.arrow_udf(from_arrow_type(_ARROW_EDGES))
def _edges(texts: pa.Array, y0: pa.Array, y1: pa.Array, tall: pa.Array) -> pa.Array:
    """The outline of each page, its first lines and its last ones above the footer, as they are written."""
    out = []
    for t, a, b, h in zip(texts.to_pylist(), y0.to_pylist(), y1.to_pylist(), tall.to_pylist()):
        p = layout(t, a, b, h)
        lines = [[t[i] for i in l] for l in p.lines]
        body = lines[:-1] if p.foot else lines
        out.append({"outline": outline(p), "head": lines[:REACH], "tail": body[-REACH:]})
    return pa.array(out, _ARROW_EDGES)


def lines_before(around: dict[int, dict]) -> list[list[str]]:
    """The last lines of the page before, without its footer, as written."""
    return (around[-1]["tail"] or []) if -1 in around else []


def lines_behind(own: dict, page: int, around: dict[int, dict]) -> list[list[str]]:
    """The first lines of the next page, without its running header, as written."""
    if 1 not in around:
        return []
    there = {-1: own} | ({1: around[2]["outline"]} if 2 in around else {}) | ({-2: around[-1]["outline"]} if -1 in around else {})
    lines = around[1]["head"] or []
    return lines[1:] if lines and is_header(around[1]["outline"], page + 1, there) else lines


def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, file_id, page, word_id, text, y0, y1, conf of both word tables."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("src"), "file_id", "page", "word_id", "text", "y0", "y1", (F.col(c) if c else F.lit(None).cast("double")).alias("conf")) for t, c in SOURCES.items()]
    return parts[0].unionByName(parts[1])


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page, height of the pages whose size is known."""
    return table(spark, sf_dir, "pages_meta").select("file_id", "page", "height")


def pages_in_context(words: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row per src, file_id and page: ids, texts, y0, y1, conf in reading order (conf is null where ``words`` has none); tall (its height, null where unknown); outline; around: of the
    two pages before and the two behind each outline with its distance, and the edge lines of the nearest.

    Repeated rows (same page and word_id) count once, null texts count as empty, rows with null word_id, file or page are left out.
    """
    conf = F.col("conf") if "conf" in words.columns else F.lit(None).cast("double")
    word = F.struct("word_id", F.coalesce("text", F.lit("")).alias("text"), "y0", "y1", conf.alias("conf"))
    by = ["src", "file_id", "page"]
    pages = spread(words.where("word_id is not null and file_id is not null and page is not null"), *by).groupBy(*by).agg(F.array_sort(F.collect_set(word)).alias("w"))
    tall = F.lit(None).cast("double")
    if sizes is not None:
        # once per source, so that pages stay where they are and only the small table moves
        each = sizes.groupBy("file_id", "page").agg(F.max("height").alias("tall")).withColumn("src", F.explode(F.array(*[F.lit(t) for t in SOURCES])))
        pages, tall = pages.join(each, by, "left"), F.col("tall")
    field = lambda f: F.transform("w", lambda x: x[f])
    pages = pages.select(*by, tall.alias("tall"), field("word_id").alias("ids"), field("text").alias("texts"), *[field(c).alias(c) for c in ("y0", "y1", "conf")])
    pages = cut(pages.withColumn("e", _edges("texts", "y0", "y1", "tall")).select("*", "e.outline", "e.head", "e.tail").drop("e"))
    steps = F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])).alias("d")
    # the page d behind this one sees it at distance -d, and the lines on its own side of it
    lines = [F.when(F.col("d") == d, F.col(c)).alias(c) for c, d in (("tail", 1), ("head", -1))]
    shown = pages.select("src", "file_id", "page", "outline", "head", "tail", steps).select("src", "file_id", (F.col("page") + F.col("d")).alias("page"), F.struct((-F.col("d")).alias("d"), "outline", *lines).alias("n"))
    around = shown.groupBy(*by).agg(F.collect_list("n").alias("around"))
    return pages.drop("head", "tail").join(around, by, "left")

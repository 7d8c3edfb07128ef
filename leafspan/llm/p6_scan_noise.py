"""Problem 6: noise in text from scanned pages: running headers and page numbers, words divided at line ends, misread words.

Misread words come from anagram hash differences: the hash of a word is the sum of its letters' values, so two words that
differ by a few letters have equal hashes once those letters are taken away. The vocabulary is joined with its frequent
part on such hashes in SQL, the pairs are checked by edit distance and ranked by how much commoner the frequent one is. Words
that no vocabulary holds (numbers, names) are judged by their shape in the same way: a broken shape meets the frequent shapes it can be
confused with. Margin lines and divided words are found page by page; whether a divided word keeps its hyphen is told by how often it is
written with and without one.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from leafspan.llm.p1_terms import term_column
from leafspan.llm.pages import Page, all_words, bare, is_header, layout, lines_before, lines_behind, page_number_words, page_sizes, pages_in_context
from leafspan.session import cut

#: Least number of times by which a word is commoner than what is taken for its misreading, by its length (6 for all longer ones).
TIMES = {2: 100, 3: 40, 4: 20, 5: 12, 6: 8}
#: Points of confidence by which a word is read less surely than its frequent form that count as evidence, and what they divide TIMES by.
DOUBT, DOUBTED = 15.0, 2.0
#: Share of all words from which the two parts of a divided word are words of their own.
PART = 1e-5
#: Letters from which two separate edits are no chance.
APART = 7
_MARKS = "-‐‑‒–—¬­"
#: Marks that can also be a hyphen of the word.
_HYPHENS = "-‐‑"
#: Pairs of signs that are read for one other sign.
LOOKALIKES = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("nn", "m"))
_INVISIBLE = re.compile("[​‌‍⁠﻿\xa0\\s]+$|^[​‌‍⁠﻿\xa0\\s]+")
#: Behind "over-" and the like these open a second member, not the rest of a word.
_JOINING = {"and", "or", "und", "et", "y", "to", "&"}


def margins(p: Page, own: dict, page: int, around: dict[int, dict]) -> tuple[dict[int, str], list[int]]:
    """Kinds of the words in running headers and footers, and the lines of the body."""
    kinds: dict[int, str] = {}
    lines = list(range(len(p.lines)))
    edge = []
    if p.foot:
        edge.append(lines.pop())
    if lines and is_header(own, page, around):
        edge.append(lines.pop(0))
    for k in edge:
        words = [p.text[i] for i in p.lines[k]]
        for i, number in zip(p.lines[k], page_number_words(words)):
            kinds[i] = "pageno" if number else "header"
    return kinds, lines


def divided(raw: list[str], words: list[int]) -> tuple[list[int], str, str] | None:
    """The last words of a line that end in a division mark: their places, the text before the mark, the mark."""
    if not words:
        return None
    last = _INVISIBLE.sub("", raw[words[-1]]).rstrip("\"'”’»)]}")
    if not last or last[-1] not in _MARKS:
        return None
    stem = last.rstrip(_MARKS).strip()
    places = [words[-1]]
    if not stem:
        if len(words) < 2 or last[-1] in "—" or len(last) > 1:
            return None
        places = words[-2:]
        stem = _INVISIBLE.sub("", raw[words[-2]])
    stem = stem.lstrip("\"'“‘«([{„")
    return (places, stem, last[-1]) if stem and stem[-1].isalpha() else None


def continues(stem: str, word: str) -> bool:
    """Whether ``word`` can be the rest of a word that began with ``stem``."""
    w = word.lstrip("\"'“‘«([{„*~`.,:;")
    if not w or bare(w) in _JOINING:
        return False
    return w[0].islower() or (w[0].isupper() and len(stem) > 1 and stem.isupper()) or (w[0].isdigit() and any(c.islower() for c in w))


class Join(NamedTuple):
    """A word divided at the end of a line: the places of its pieces on the page (-1 for one on another page), the word without its mark and,
    where the mark can be a hyphen, with it."""

    head: int
    rest: int
    joined: str
    hyphenated: str | None


def page_kinds(texts: list[str], y0: list[float], y1: list[float], own: dict, page: int, near: list[dict], tall: float | None = None) -> tuple[list[tuple[int, str]], list[Join], list[list[int]]]:
    """(place, kind) of the page's margin words and pieces, its divided words, and the body lines as places."""
    p = layout(texts, y0, y1, tall)
    around = {n["d"]: n for n in near}
    kinds, body = margins(p, own, page, {d: n["outline"] for d, n in around.items()})
    found, joins, lines = list(kinds.items()), [], [p.lines[k] for k in body]

    def join(d: tuple[list[int], str, str], head: int, rest: int, text: str) -> None:
        joins.append(Join(head, rest, d[1] + text, f"{d[1]}-{text}" if d[2] in _HYPHENS else None))

    for a, b in zip(lines, lines[1:]):
        if (d := divided(texts, a)) and continues(d[1], texts[b[0]]):
            found += [(i, "hyphen") for i in (*d[0], b[0])]
            join(d, d[0][0], b[0], texts[b[0]])
    if lines and (d := divided(texts, lines[-1])) and (behind := lines_behind(own, page, around)) and continues(d[1], behind[0][0]):
        found += [(i, "hyphen") for i in d[0]]
        join(d, d[0][0], -1, behind[0][0])
    if lines and (before := lines_before(around)) and (d := divided(before[-1], list(range(len(before[-1]))))) and continues(d[1], texts[lines[0][0]]):
        found.append((lines[0][0], "hyphen"))
        join(d, -1, lines[0][0], texts[lines[0][0]])
    return found, joins, lines


_ARROW_MARK = pa.list_(pa.struct([("kind", pa.string()), ("joined", pa.string()), ("hyphenated", pa.string()), ("head", pa.bool_())]))


@F.arrow_udf(from_arrow_type(_ARROW_MARK))
def _marks(texts: pa.Array, y0: pa.Array, y1: pa.Array, own: pa.Array, page: pa.Array, around: pa.Array, tall: pa.Array) -> pa.Array:
    out = []
    for t, a, b, o, p, n, h in zip(*(x.to_pylist() for x in (texts, y0, y1, own, page, around, tall))):
        found, joins, _ = page_kinds(t, a, b, o, p, n or [], h)
        rows: list[dict | None] = [None] * len(t)
        for k, kind in found:
            rows[k] = {"kind": kind, "joined": None, "hyphenated": None, "head": None}
        for j in joins:
            for k, head in ((j.head, True), (j.rest, False)):
                if k >= 0:
                    rows[k] |= {"joined": j.joined, "hyphenated": j.hyphenated, "head": head}
        out.append(rows)
    return pa.array(out, _ARROW_MARK)


def marked_words(pages: DataFrame) -> DataFrame:
    """src, file_id, page, word_id, text, conf of every word of ``pages``, with kind (header, pageno, hyphen or null), joined and hyphenated (the whole of a
    divided word, without its mark and with a hyphen in its place) and head (whether this piece is its beginning)."""
    one = F.explode(F.arrays_zip(F.col("ids").alias("word_id"), F.col("texts").alias("text"), "conf", _marks("texts", "y0", "y1", "outline", "page", "around", "tall").alias("mark"))).alias("w")
    return pages.select("src", "file_id", "page", one).select("src", "file_id", "page", "w.word_id", "w.text", "w.conf", "w.mark.*")


# -- misread words ---------------------------------------------------------------------------------------------------


def _value(c: F.Column) -> F.Column:
    """What a letter adds to the hash: 56 bits of its hash, so that sums of a hundred letters fit a BIGINT."""
    return F.shiftright(F.xxhash64(c), 8)


def _less(text: F.Column, letters: int) -> F.Column:
    """h, side of a text: its anagram hash less nothing, less each letter and, for two ``letters``, less any two of them; side is whether what was taken away stands side by side."""
    v = F.transform(F.split(text, ""), _value)
    entry = lambda h, side: F.struct(h.alias("h"), F.lit(side).alias("side"))
    two = lambda h, start, n, side: F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + start, n), lambda y: entry(h - x - y, side))))

    def of(h: F.Column) -> F.Column:
        out = [F.array(entry(h, True)), F.transform(v, lambda x: entry(h - x, True))]
        if letters == 2:
            # only words from five letters on may be two edits away
            out += [F.when(F.length(text) >= 4, two(h, 2, F.lit(1), True)), F.when(F.length(text) >= 5, two(h, 3, F.size(v), False))]
        return F.flatten(F.array_compact(F.array(*out)))

    return F.get(F.transform(F.array(F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + x)), of), F.lit(0))


def _hashes(words: DataFrame, keep: list[str], variants: bool = False) -> DataFrame:
    """Each word with its anagram hash less nothing, less each letter and less any two letters, so that all pairs within two edits meet;
    with ``variants`` also the hashes, less nothing and less each letter, of the word with two signs read as the one they look like."""
    other = [F.when(F.contains("word", F.lit(pair)), _less(F.replace("word", F.lit(pair), F.lit(sign)), 1)) for pair, sign in LOOKALIKES] if variants else []
    hashes = F.flatten(F.array_compact(F.array(_less(F.col("word"), 2), *other)))
    return words.select(*keep, F.explode(F.array_distinct(hashes)).alias("h")).select(*keep, "h.*").where("h <> 0")


def confusable_pairs(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, meant, side, d and the columns of both (those of ``known`` end in _meant) for all pairs within two edits, each once; d is the edit
    distance, two signs that are read for one counting as one edit, and side is whether the edits stand side by side."""
    columns = [c for c in words.columns if c != "word"]
    left = _hashes(words, words.columns, variants=True)
    right = _hashes(known, known.columns).select(F.col("word").alias("meant"), *[F.col(c).alias(f"{c}_meant") for c in columns], "h", F.col("side").alias("side_meant"))
    pairs = left.join(right, "h").where(F.col("word") != F.col("meant")).groupBy("word", "meant", *columns, *[f"{c}_meant" for c in columns]).agg(F.max(F.col("side") & F.col("side_meant")).alias("side"))
    d = F.least(F.levenshtein("word", "meant"), *[F.when(F.contains("word", F.lit(pair)), F.levenshtein(F.replace("word", F.lit(pair), F.lit(sign)), F.col("meant")) + 1) for pair, sign in LOOKALIKES])
    return pairs.withColumn("d", d).where("d <= 2")


def misread_words(counts: DataFrame) -> DataFrame:
    """word, meant, of the words of ``counts`` (word, n, capital: how often with a capital, conf: mean confidence) that are taken for misreadings of a
    frequent word. Words nearly always written with a capital are names and no misreadings of words that are not.

    How much commoner the frequent word must be depends on the length (TIMES), as short words have many neighbours of their own, and is less where
    the word is read much less surely; nothing depends on absolute counts, so a word is judged alike in a corpus of any size. All pairs within two
    edits are compared. Two edits that do not stand side by side count from APART letters on, or where the word has signs that are no
    letters: shorter words have chance neighbours at that distance. The nearest word is the correction, then one whose edits stand side by
    side, then the commoner, then the last in order. Words without letters are left alone.
    """
    words = counts.where(F.col("word").rlike(r"\p{L}") & F.length("word").between(2, 100))
    # one more occurrence of either kind: a few capitals are no habit
    words = words.select("word", "n", (F.col("capital") + 1 >= 0.85 * (F.col("n") + 2)).alias("proper"), "conf")
    times = F.lit(TIMES[6])
    for length in (5, 4, 3, 2):
        times = F.when(F.length("meant") <= length, TIMES[length]).otherwise(times)
    times = times / F.when(F.coalesce(F.col("conf") + DOUBT <= F.col("conf_meant"), F.lit(False)), DOUBTED).otherwise(1.0)
    least = min(TIMES.values()) / DOUBTED
    known = words.where((F.col("n") >= least) & F.col("word").rlike(r"^[\p{L}'’-]+$"))
    pairs = confusable_pairs(words, known).where((F.col("n_meant") >= times * F.col("n") * F.when(F.col("d") == 2, 3).otherwise(1)) & ~(F.col("proper") & ~F.col("proper_meant")))
    pairs = pairs.where(F.length("meant") >= F.when(F.col("d") == 2, 5).otherwise(2))
    pairs = pairs.where((F.col("d") < 2) | F.col("side") | (F.least(F.length("word"), F.length("meant")) >= APART) | F.col("word").rlike(r"[^\p{L}\p{M}'’-]"))
    # an inflection is no misreading
    inflected = (F.regexp_replace("word", r"['’]?s$", "") == F.regexp_replace("meant", r"['’]?s$", "")) & (F.length("meant") > 1)
    best = F.max(F.struct((-F.col("d")).alias("s"), F.col("side"), F.col("n_meant"), F.col("meant")))["meant"]
    return pairs.where(~inflected).groupBy("word").agg(best.alias("meant"))


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shape(text: F.Column) -> F.Column:
    """A text with a for each small letter, A for each capital and 0 for each digit."""
    plain = F.translate(text, _SMALL + _LARGE + "123456789", "a" * 26 + "A" * 26 + "0" * 9)
    return F.when(plain.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.regexp_replace(plain, r"\p{Ll}", "a"), r"\p{Lu}", "A")).otherwise(plain)


def misread_shapes(counts: DataFrame) -> DataFrame:
    """word, of the broken shapes of ``counts`` (word: a shape, n, broken) that a frequent whole shape can be confused with."""
    shapes = counts.where(F.length("word").between(2, 100))
    known = shapes.where(~F.col("broken")).select("word", "n")
    return confusable_pairs(shapes.where("broken").select("word", "n"), known).where(F.col("n_meant") >= TIMES[6] * F.col("n")).select("word").distinct()


def broken(text: F.Column) -> F.Column:
    """Whether a text has a shape that print has not: signs inside words, letters inside numbers or digits inside words."""
    inner = F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    # ordinals, house numbers and extensions; addresses of mail and hosts
    house = inner.rlike(r"^(x[0-9]+|[0-9]+[a-zA-Z]|[0-9]+(st|nd|rd|th))$") | text.contains("@") | inner.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$")
    mixed = inner.rlike(r"\p{Ll}[0-9]|[0-9]\p{Ll}|\p{Ll}\p{Lu}") & ~inner.rlike(r"^\p{Lu}?[’']?\p{Lu}\p{Ll}+\p{Lu}\p{Ll}*$")
    sign = inner.rlike(r"\p{L}[*~`^|:;,!<>=_\\{}\[\]\"]+\p{L}") | inner.rlike(r"[0-9][*~`^|]+[0-9]") | text.rlike(r"[*~`^]")
    number = inner.rlike(r"^[0-9./$-]*[0-9][A-Za-z][0-9./-]*[0-9]$") | inner.rlike(r"^[0-9]{1,2}/[0-9A-Za-z]{1,2}/[0-9A-Za-z]{2,4}$") & inner.rlike("[A-Za-z]")
    return ((mixed & ~house) | (sign & ~text.contains("@")) | (number & ~house)).alias("broken")


def kept_hyphens(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """word, kept: the divided words (``pieces``: word without mark, hyphenated) that keep their hyphen, as terms.

    Evidence are the undivided words of ``counts`` (word, whole): a word keeps its hyphen if it is written so more often than in one, or, where it
    is written neither way, if both its parts are words of their own (a share PART of all words or more).
    """
    forms = pieces.where("hyphenated is not null").select("word", "hyphenated").distinct()
    parts = F.split("hyphenated", "-")
    roles = {"joined": F.col("word"), "hyphen": F.col("hyphenated"), "first": F.get(parts, F.lit(0)), "second": F.element_at(parts, -1)}
    asked = forms.select(F.col("word").alias("of"), "hyphenated", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), c.alias("word")) for k, c in roles.items()])).alias("r")).select("of", "hyphenated", "r.*")
    n = lambda k: F.coalesce(F.max(F.when(F.col("role") == k, F.col("whole"))), F.lit(0))
    seen = asked.join(counts.select("word", "whole"), "word", "left").groupBy("of", "hyphenated").agg(*[n(k).alias(k) for k in roles])
    total = counts.agg(F.sum("whole")).scalar()
    own = F.least("first", "second") >= F.greatest(F.lit(1.0), PART * total)
    return seen.where((F.col("hyphen") > F.col("joined")) | ((F.col("hyphen") == 0) & (F.col("joined") == 0) & own)).groupBy(F.col("of").alias("word")).agg(F.min("hyphenated").alias("kept"))


def _noise(pages: DataFrame) -> DataFrame:
    """src, file_id, page, word_id, kind, correction of every noisy word of ``pages``."""
    # a piece is judged by the word it belongs to
    stem = F.regexp_replace(F.coalesce(term_column("text"), F.lit("")), r"[^\p{L}\p{N}]", "")
    term = F.when(~F.col("text").rlike(r"^\s*\.\p{L}|@"), term_column(F.coalesce("joined", "text")))
    edge = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    row = ["src", "file_id", "page", "word_id"]
    whole = marked_words(pages).where("text <> ''").select(
        *row, "kind", "conf", F.col("text").rlike(r"^[^\p{L}]*\p{Lu}").alias("capital"), "head", F.when(F.col("joined").isNotNull(), stem).alias("stem"), term.alias("word"),
        F.regexp_replace(F.lower("hyphenated"), edge, "").alias("hyphenated"), "joined", shape(F.trim("text")).alias("shape"), broken(F.col("text")),
    )
    whole = cut(whole)
    counts = cut(whole.where("word is not null and not coalesce(not head, false)").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stem").isNull()).alias("whole"), F.count_if("capital").alias("capital"), F.avg("conf").alias("conf")))
    pieces = whole.where("stem is not null")
    pieces = cut(pieces.join(kept_hyphens(pieces, counts), "word", "left"))
    meant = cut(misread_words(counts))
    # of a divided word only the piece that differs from what was meant is misread
    fits = F.when(F.col("head"), F.startswith("meant", F.col("stem"))).otherwise(F.endswith(F.col("meant"), F.col("stem")))
    found = lambda kind, correction: [*row, F.lit(kind).alias("kind"), F.coalesce(correction, F.lit(None).cast("string")).alias("correction")]
    by_word = whole.where("stem is null").join(meant, "word").unionByName(pieces.withColumn("word", F.coalesce("kept", "word")).drop("kept").join(meant, "word").where(~fits)).select(*found("misread", F.col("meant")))
    shapes = misread_shapes(whole.groupBy(F.col("shape").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.max("broken").alias("broken")))
    by_shape = whole.where("broken").select(*row, F.col("shape").alias("word")).join(shapes, "word", "left_semi").select(*found("misread", F.lit(None)))
    hyphens = pieces.select(*found("hyphen", F.coalesce("kept", F.col("joined"))))
    plain = whole.where("kind is not null").select(*row, "kind", F.lit(None).cast("string").alias("correction"))
    return plain.unionByName(hyphens).unionByName(by_word).unionByName(by_shape).groupBy(*row, "kind").agg(F.max("correction").alias("correction"))


def find_noise(words: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """src, word_id, kind, correction of every noisy word of ``words`` (src, file_id, page, word_id, text, y0, y1, conf); ``sizes`` (file_id, page,
    height) tells where the foot of a page is.

    A word can have several kinds, one row each; correction is the whole word of a piece and the frequent form of a misread word,
    null where none is known. Null and empty texts have no kinds. Repeated rows count once; rows without word_id, file or page
    are left out. An empty table gives an empty result.
    """
    return _noise(pages_in_context(words, sizes)).select("src", "word_id", "kind", "correction")


# -- repaired text ---------------------------------------------------------------------------------------------------

_ARROW_PARAGRAPHS = pa.list_(pa.struct([("paragraph", pa.string()), ("continues", pa.bool_())]))


_RIM = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)
#: Signs that print has not: at the rim of a misread word they are part of the misreading.
_STRAY = str.maketrans("", "", "*~`^|\\_")


def corrected(text: str, correction: str | None) -> str:
    """``correction`` with the edge signs and the case of ``text``."""
    if correction is None:
        return text
    before, core, after = _RIM.match(text).groups()
    if sum(c.isalpha() for c in core) > 1 and core.isupper():
        correction = correction.upper()
    elif core[:1].isupper():
        correction = correction[:1].upper() + correction[1:]
    return before.translate(_STRAY) + correction + after.translate(_STRAY)


def page_paragraphs(t: list[str], y0: list[float], y1: list[float], own: dict, page: int, near: list[dict], tall: float | None, fixes: list[dict], after: list[dict], ids: list[int]) -> list[dict]:
    """The paragraphs of a page; ``fixes`` has, for its words, what a misread word was meant to be (meant) and the whole of a divided word (whole),
    ``after`` those of the pieces on the next page."""
    _, joins, lines = page_kinds(t, y0, y1, own, page, near, tall)
    fix = {x["word_id"]: x for x in fixes}
    meant = {x["whole"]: x["meant"] for x in [*after, *fixes] if x["whole"] and x["meant"]}
    begun = {j.head: j.joined for j in joins if j.head >= 0}
    skip = {j.rest for j in joins if j.rest >= 0}
    width = max((len(l) for l in lines), default=0)
    paragraphs, now = [], []
    for l in lines:
        # a divided word stands whole where it began; of one begun on the page before nothing is left here
        for k in l:
            known = fix.get(ids[k], {})
            if k in begun:
                whole = known.get("whole") or begun[k]
                now.append(corrected(begun[k] if whole == begun[k] else corrected(begun[k], whole), meant.get(whole)))
            elif k not in skip and not (k - 1 in begun and not bare(t[k]).strip(_MARKS)):
                now.append(corrected(t[k].strip(), known.get("meant")))
        if now and (len(l) < 0.55 * width and not (l[-1] in begun) or now[-1][-1:] in ".?!;" and len(l) < 0.8 * width):
            paragraphs.append(" ".join(now))
            now = []
    if now:
        paragraphs.append(" ".join(now))
    return [{"paragraph": x, "continues": k == 0 and (bool(lines) and lines[0][0] in skip or x[:1].islower())} for k, x in enumerate(paragraphs)]


@F.arrow_udf(from_arrow_type(_ARROW_PARAGRAPHS))
def _paragraphs(texts: pa.Array, y0: pa.Array, y1: pa.Array, own: pa.Array, page: pa.Array, around: pa.Array, tall: pa.Array, fixes: pa.Array, after: pa.Array, ids: pa.Array) -> pa.Array:
    columns = zip(*(x.to_pylist() for x in (texts, y0, y1, own, page, around, tall, fixes, after, ids)))
    return pa.array([page_paragraphs(t, a, b, o, p, n or [], h, f or [], g or [], i) for t, a, b, o, p, n, h, f, g, i in columns], _ARROW_PARAGRAPHS)


def joined_over_pages(made: DataFrame) -> DataFrame:
    """src, file_id, page, position, paragraph, to_page from the paragraphs of pages: one that continues is put to the last one of the page
    before. The page it begins on is carried along one small row per page in a running window; texts meet only within a paragraph."""
    by, order = ["src", "file_id"], Window.partitionBy("src", "file_id").orderBy("page")
    pages = made.groupBy(*by, "page").agg(F.max("position").alias("last"), F.max("continues").alias("continues"))
    pages = pages.withColumn("continues", F.col("continues") & F.coalesce(F.lag("page").over(order) == F.col("page") - 1, F.lit(False)))
    # the paragraph that stands last on a page begins there unless the page has only one, which continues
    ends = F.when(~F.col("continues") | (F.col("last") > 0), F.struct("page", F.col("last").alias("position")))
    pages = pages.withColumn("ends", F.last(ends, ignorenulls=True).over(order)).withColumn("begin", F.when(F.col("continues"), F.lag("ends").over(order)))
    p = made.drop("continues").join(pages.where("continues").select(*by, "page", F.lit(0).alias("position"), "begin"), [*by, "page", "position"], "left")
    p = p.select(*by, F.coalesce("begin", F.struct("page", "position")).alias("begin"), F.struct("page", "paragraph").alias("part"))
    parts = F.array_sort(F.collect_list("part"))
    return p.groupBy(*by, "begin").agg(parts.alias("parts")).select(*by, "begin.page", F.col("begin.position").cast("bigint").alias("position"), F.concat_ws(" ", "parts.paragraph").alias("paragraph"), F.element_at("parts", -1)["page"].alias("to_page"))


def repaired_text(words: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """src, file_id, page, position, paragraph, to_page: the body of each file as paragraphs, by the page and the position on it where each
    begins, and the page where it ends. Divided words are joined where they began, corrections of misread words stand between the signs at the word's edges
    and in its case, and margins are left out. A paragraph that carries on over a page break is one, unless the next page is missing or has no text."""
    pages = pages_in_context(words, sizes)
    by = ["src", "file_id", "page"]
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("correction")))
    fixes = _noise(pages).where("correction is not null").groupBy(*by, "word_id").agg(of("misread").alias("meant"), of("hyphen").alias("whole"))
    fixes = cut(fixes.groupBy(*by).agg(F.collect_list(F.struct("word_id", "meant", "whole")).alias("fixes")))
    after = fixes.select("src", "file_id", (F.col("page") - 1).alias("page"), F.filter("fixes", lambda x: x["whole"].isNotNull()).alias("after"))
    pages = pages.join(fixes, by, "left").join(after, by, "left")
    made = pages.select(*by, F.posexplode(_paragraphs("texts", "y0", "y1", "outline", "page", "around", "tall", "fixes", "after", "ids")).alias("position", "p"))
    return joined_over_pages(cut(made.select(*by, "position", "p.*")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_noise(all_words(spark, sf_dir), page_sizes(spark, sf_dir)).select("src", "word_id", "kind")


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_text(all_words(spark, sf_dir), page_sizes(spark, sf_dir))


QUERIES = {"p6_found": found, "p6_text": text}
ORACLE: dict[str, str] = {}

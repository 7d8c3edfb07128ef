"""Problem 5: personal values in running text, found word by word and replaced by typed placeholders.

Every line is read, the margins too. Values are told in three ways: by the validated formats of ``formats`` wherever they stand (e-mail
addresses, telephone numbers of the numbering plans, identity numbers with their ranges and check digits, postal addresses); by what stands in
front of and around them (captions, "Dear", "call ... at", "of ... under", "... signed"), with room for misread signs; and names by the given
names and surnames that the captions of the whole corpus teach. Numbers and dates get format-preserving pseudonyms: see ``pseudonyms``.
"""

from __future__ import annotations

import re
import secrets
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from leafspan.llm import formats
from leafspan.llm.p6_scan_noise import LOOKALIKES, margins
from leafspan.llm.pages import all_words, clean, layout, lines_before, lines_behind, near, page_sizes, pages_in_context
from leafspan.llm.pseudonyms import permute_date, placeholder
from leafspan.session import cut

KINDS = ("email", "phone", "idno", "address", "name")
_DIGIT = "0-9OoIlSsBZzgqGTAi|"
_NUMBER = re.compile(rf"^[(+]*[{_DIGIT}xvj]*[0-9][{_DIGIT}a-z().+/\-‐–]*$")
#: Signs that recognition puts into values.
_STRAY = re.compile(r"[*~`'’^:|]")
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "mme", "herr", "frau", "jr", "sr"}
_CAPTIONS = {"phone": ("phone", "mobile", "tel", "fax", "telephone", "cell"), "name": ("name", "owner", "patient", "contact", "signed", "client"), "email": ("email", "e-mail")}
_STREETS = ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "way", "court", "ct", "crescent", "terrace", "blvd", "boulevard", "drive", "dr", "place", "square")
_ROMANCE = ("avenue", "rue", "via", "calle", "rua", "avenida", "plaza", "piazza", "chemin", "boulevard")
_GERMAN = re.compile(r"(weg|stra(ss|ß|b|8)e|gasse|allee|platz|ring)$", re.I)
_LINK = {"de", "del", "della", "di", "du", "des", "la", "le", "da", "do", "dos", "al", "dei"}
_OPENINGS = ("phone", "mobile", "telephone", "email", "e-mail", "passport", "licence", "license", "insurance", "chart", "address", "deliver", "visit", "dear", "call", "signed", "name", "owner", "patient", "contact", "client", "ssn", "mrn")
#: Distinct words whose looks a worker remembers.
MEMO = 1 << 17
_UNIT = ("apt", "unit", "suite", "apartment", "flat")


@lru_cache(MEMO)
def _word(text: str) -> str:
    """Without quotes and brackets around it, as they may be put round any word."""
    return text.strip("\"'“”‘’«»„[]{}<>")


@lru_cache(MEMO)
def _low(text: str) -> str:
    return _word(_word(text).lower().strip(".,;:?!()"))


@lru_cache(MEMO)
def _is(text: str, *words: str) -> bool:
    """Whether a word is one of ``words``, but for a misread sign or two in longer ones."""
    t = _low(text)
    return any(near(t, w, 0 if len(w) < 4 else 1 if len(w) < 8 else 2) for w in words)


@lru_cache(MEMO)
def _short(text: str, word: str) -> bool:
    """Whether a text is a word of two letters but for one sign, or for two signs that look like one of its letters."""
    low = _low(text)
    return any(len(x) == len(word) and near(x, word, 1) for x in (low, *(low.replace(pair, sign) for pair, sign in LOOKALIKES)))


@lru_cache(MEMO)
def _trigger(text: str) -> bool:
    """Whether a word can be, or stand at the end of, a caption or another opening of a value; the words of running text mostly can't."""
    t, low = _word(text), _low(text)
    if "@" in t or t[-1:] in ":.;,":
        return True
    if low in ("at", "fax", "tel") or _short(text, "of") or _short(text, "id") or _short(text, "no") or len(low) <= 4 and any(c.isdigit() for c in low):
        return True
    return any(near(low, x, 2) for x in _OPENINGS)


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


@lru_cache(MEMO)
def _numeric(text: str) -> bool:
    """Digits with their usual signs, some of them perhaps misread."""
    t = _STRAY.sub("", _word(text).strip(".,;:?!"))
    return bool(t) and (bool(_NUMBER.match(t)) and _digits(t) * 2 >= sum(c.isalnum() for c in t) or bool(re.fullmatch(rf"[{_DIGIT}]{{1,4}}", t)) and _digits(t) > 0)


@lru_cache(MEMO)
def _numberish(text: str, least: int) -> bool:
    t = _word(text).strip(".,;:?!()")
    return len(t) >= least and _digits(t) * 2 >= len(t)


@lru_cache(MEMO)
def _named(text: str) -> bool:
    """A word that can be part of a name: capital first (or a misread sign in its place), no digits but misread ones."""
    t = _word(text).strip(".,;:?!()*~`")
    t = re.sub(r"['’]s$", "", t)
    if not t or not any(c.isalpha() for c in t):
        return False
    letters = [c for c in t if c.isalpha()]
    return (t[0].isupper() or t[0].isdigit() and len(t) > 2 or any(c.isupper() for c in letters[:2])) and sum(c.isdigit() for c in t) * 3 <= len(t)


@lru_cache(MEMO)
def _initial(text: str) -> bool:
    t = _word(text).strip("*~`")
    return len(t) <= 3 and t[:1].isalpha() and (t.endswith((".", ",", ":")) and len(t) <= 3 or len(t) == 1 and t.isupper())


class Reader:
    """The words of a page in reading order; ``line`` is the line of each, which captions reach over but their values need not."""

    def __init__(self, words: list[str], line: list[int]):
        self.w, self.line, self.kind = words, line, [None] * len(words)

    def mark(self, i: int, j: int, kind: str) -> None:
        for k in range(i, min(j, len(self.w))):
            if self.kind[k] is None:
                self.kind[k] = kind

    def name(self, i: int, most: int = 4, same_line: bool = False) -> int:
        """End of the name that begins at ``i`` (``i`` if none): "First [M.] Last", "F. Last", "LAST, First [M.]", "Last" behind a title."""
        start, j, surname_first = i, i, False
        titled = False
        while j < len(self.w) and _low(self.w[j]) in _TITLES:
            titled, j = True, j + 1
        first = j
        while j < len(self.w) and j - first < most:
            if same_line and self.line[j] != self.line[start]:
                break
            w = self.w[j]
            if not (_named(w) or j > first and _initial(w)):
                break
            bare = _word(w)
            j += 1
            if titled:
                break
            if bare.endswith((",", ".,", ",:")) and j - first == 1 and len(bare) > 3:
                surname_first = True
                continue
            if surname_first and not _initial(w):
                if j < len(self.w) and _initial(self.w[j]) and (not same_line or self.line[j] == self.line[start]):
                    j += 1
                break
            if bare[-1:] in ".;:?!" and not _initial(w) and len(bare) > 3 or re.search(r"['’]s$", bare):
                break
            if not _initial(w) and j - first >= 2:
                break
        return j if j > first else i

    def phone(self, i: int, same_line: bool = False) -> int:
        """End of the phone number at ``i``: up to six number words, then an extension."""
        j, got = i, 0
        while j < len(self.w) and j - i < 6:
            if same_line and self.line[j] != self.line[i]:
                break
            w = _STRAY.sub("", _word(self.w[j]))
            if not (_numeric(w) or re.fullmatch(r"[(+]?[0-9A-Za-z]{1,4}\)?[-.]?", w) and _digits(w) and (j > i or len(w) <= 3)):
                break
            if re.search(r"/", w) and got >= 7:
                break
            got += _digits(w)
            j += 1
            if re.fullmatch(r"[xX]\d{1,5}", w.strip(".,;?!")) or w[-1:] in ".,;?!" and got >= 7:
                break
        if got < 5:
            return i
        if j < len(self.w) and _word(self.w[j - 1])[-1:] not in ".;?!" and re.fullmatch(rf"(x|ext\.?)\s*[{_DIGIT}]{{0,5}}", _word(self.w[j]).strip(".,;:?!"), re.I):
            j += 1
        return j

    def idno(self, i: int) -> int:
        """End of the number of a person at ``i``: one word, or pieces of it such as "QQ 12 34 56 C" and "900 06 1836"."""
        j, got = i, 0
        while j < len(self.w) and j - i < 5:
            w = _word(self.w[j])
            t = w.strip(".,;:?!()")
            if not t:
                break
            piece = _digits(t) * 2 >= len(t) or (j == i and len(t) == 2 and t.isupper()) or (j > i and len(t) <= 2 and any(c.isdigit() for c in t)) or (j > i and len(t) == 1 and t.isalpha() and got >= 5) or (j == i and _digits(t) >= 3) or (j > i and len(t) == 2 and got >= 2 and not t.islower())
            if not piece:
                break
            got += _digits(t)
            j += 1
            if w[-1:] in ".,;?!" or len(t) >= 7 or (len(t) == 1 and t.isalpha()):
                break
        return j if got >= 3 else i

    def address(self, i: int) -> int:
        """End of the address at ``i``."""
        w, n = self.w, len(self.w)
        if i >= n:
            return i
        j = i
        if _numberish(w[i], 1) or re.fullmatch(r"[0-9A-Za-z]{0,2}[0-9]{2,4}[0-9A-Za-z]?", _word(w[i])):
            j = i + 1
            linked = j + 1 < n and _low(w[j + 1]) in _LINK and any(near(_low(w[j]), x, 1) for x in _ROMANCE)
            if linked or j < n and _is(w[j], *_ROMANCE) and (_word(w[j])[:1].islower() or j + 1 < n and _low(w[j + 1]) in _LINK):
                j += 1
                while j < n and (_low(w[j]) in _LINK or len(_low(w[j])) <= 3 and _word(w[j])[:1].islower()):
                    j += 1
                if j < n:
                    j += 1
                    if _word(w[j - 1]).endswith(",") and j < n and _named(w[j]):
                        j += 1
                return j
            k = j
            while k < min(j + 4, n) and _named(w[k]):
                k += 1
                if _is(w[k - 1], *_STREETS) and k - j >= 2:
                    break
            if k == j:
                return i
            j = k
        elif _named(w[i]) and i + 1 < n and (_GERMAN.search(_low(w[i])) or _numberish(w[i + 1], 1)) and "/" not in w[i + 1]:
            if not (i + 2 < n and _numberish(w[i + 1], 1)) and not _GERMAN.search(_low(w[i])):
                return i
            j = i + 2 if _digits(w[i + 1]) else i + 1
            if j < n and _numberish(w[j], 4):
                j += 1
                if j < n and _named(w[j]):
                    j += 1
            return j
        else:
            return i
        # unit, town, region and postal code
        if j < n and (_is(w[j], *_UNIT) and j + 1 < n):
            j += 2
        elif j < n and _word(w[j]).startswith("#"):
            j += 1
        for k in range(j, min(j + 5, n - 1)):
            region = re.fullmatch(r"[A-Za-z0-9]{2}", _word(w[k]).strip(".,;:?!")) and not _word(w[k]).islower()
            if region and _numberish(w[k + 1], 4) and (k == j or all(_named(x) for x in w[j:k])):
                return k + 2
        return j

    def email(self, i: int) -> int:
        """End of the e-mail address at ``i``, whose pieces may stand apart before "@" and before a full stop."""
        j = i + 1
        while j < len(self.w) and j - i < 4:
            a, b = _word(self.w[j - 1]), _word(self.w[j])
            if b.startswith("@") and len(b) > 1 and "@" not in a or b == "@" or a == "@" or a.endswith("@") or re.match(r"^\.[a-z]", b) or "@" in a and a.endswith(".") and re.fullmatch(r"[a-z]{2,8}[.,;?]?", b):
                j += 1
            else:
                break
        return j


def page_values(words: list[str], line: list[int]) -> list[str | None]:
    """The kind of each word of a page (or None)."""
    r = Reader(words, line)
    w, n = words, len(words)

    def caption(i: int) -> str | None:
        t = _word(w[i])
        colon = t[-1:] in ":.;,"
        if _is(t, "phone", "mobile", "telephone") and colon or _low(t) in ("tel", "fax") or re.fullmatch(r"(te[l1i]|fa[xr])[.:]", t.lower()):
            return "phone"
        if near(_low(t), "email", 1) and (colon or len(_low(t)) >= 5) or near(_low(t), "e-mail", 1) and len(_low(t)) >= 5:
            return "email"
        if colon and _is(t, "ssn", "mrn") or near(_low(t), "ssn", 1) and colon and t.isupper() or near(_low(t), "mrn", 1) and colon and t.isupper():
            return "idno"
        if _is(t, "passport", "licence", "license", "insurance", "chart") or _short(t, "id") and i and _is(w[i - 1], "tax", "patient"):
            return "idno"
        if _short(t, "no") and i and _is(w[i - 1], "passport", "licence", "license", "insurance", "chart", "security"):
            return "idno"
        if i and len(t) <= 4 and _digits(t) <= 1 and (_is(w[i - 1], "security") and i > 1 and _is(w[i - 2], "social") or _is(w[i - 1], "insurance", "passport", "licence") and w[i - 1][:1].isupper()):
            return "idno"
        if t[-1:] in ":;." and t[:1].isupper() | t[:1].isdigit() and any(near(_low(t), x, 1) for x in _CAPTIONS["name"]) and t[-1:] != ".":
            return "name"
        if t[-1:] in ":;" and near(_low(t), "address", 2) or t[:1].isupper() and near(_low(t), "address", 1) and (i == 0 or line[i - 1] != line[i]):
            return "address"
        return None

    i = 0
    while i < n:
        if not _trigger(w[i]) and not (i and _low(w[i - 1]) in ("security", "insurance", "passport", "licence")):
            i += 1
            continue
        t = _word(w[i])
        low = _low(t)
        if "@" in t and len(t) > 1 or t == "@" and 0 < i < n - 1 and "." in w[i + 1] and not _numeric(w[i + 1]) and not _numeric(w[i - 1]):
            start = i - 1 if t.startswith("@") and i and not w[i - 1].endswith((":", ";", "?")) and not _is(w[i - 1], "email", "e-mail", "from", "to") and "@" not in w[i - 1] else i
            end = r.email(i)
            if not (t.startswith("@") and i and _numeric(w[i - 1])):
                r.mark(start, end, "email")
                i = end
                continue
        if low == "at" and 0 < i < n - 1 and re.match(r"^[A-Za-z0-9][\w.-]*\.[A-Za-z]{2,7}[.,;:?]?$", _word(w[i + 1])) and not _numeric(w[i + 1]):  # "name [at] domain"
            r.mark(i - 1, i + 2, "email")
            i += 2
            continue
        kind = caption(i)
        j = i + 1
        if kind == "email" and j < n and line[j] == line[i] and r.kind[j] is None and not caption(j):
            end = r.email(j)
            if "@" in "".join(w[j:end]) or re.search(r"[a-z0-9][._+-][a-z]", _word(w[j])):
                r.mark(j, end, "email")
                i = end
                continue
        elif kind == "phone":
            end = r.phone(j, same_line=False)
            if end > j:
                r.mark(j, end, "phone")
                i = end
                continue
        elif kind == "idno":
            while j < n and j - i <= 2 and _short(w[j], "no"):
                j += 1
            end = r.idno(j)
            if end > j:
                r.mark(j, end, "idno")
                i = end
                continue
        elif kind == "address" or near(low, "visit", 1) and i and (_is(w[i - 1], "or") or i > 1 and r.kind[i - 2] == "email" and len(_low(w[i - 1])) <= 3) or _is(t, "deliver") and len(low) <= 7 and t[:1].isupper():
            end = r.address(j)
            if end > j:
                r.mark(j, end, "address")
                i = end
                continue
        elif kind == "name" and j < n and line[j] == line[i]:
            end = r.name(j, same_line=True)
            plain = _word(w[j]).isupper() and end - j == 2 and not _word(w[j]).endswith((",", ".")) and not _word(w[j + 1]).strip(".,;:'’s").isupper() and near(low, "patient", 1)
            if end > j and not plain:
                while j < end and _low(w[j]) in _TITLES:
                    j += 1
                r.mark(j, end, "name")
                i = end
                continue
        elif near(low, "dear", 1) and t[:1].isupper() and j < n and _named(w[j]) and not _initial(w[j]):
            r.mark(j, j + 1, "name")
            i = j + 1
            continue
        elif near(low, "call", 1) and i and _is(w[i - 1], "please"):
            end = r.name(j)
            at = end
            while at < n and at < end + 2 and _low(w[at]) != "at" and not (len(_low(w[at])) == 2 and at + 1 < n and _numeric(w[at + 1])):
                at += 1
            while j < end and _low(w[j]) in _TITLES:
                j += 1
            r.mark(j, end, "name")
            if at < n:
                stop = r.phone(at + 1)
                r.mark(at + 1, stop, "phone")
                end = max(end, stop)
            i = max(end, i + 1)
            continue
        elif _short(t, "of") and j < n and (_named(w[j]) or _low(w[j]) in _TITLES):
            end = r.name(j)
            if end > j and end < n and near(_low(w[end]), "under", 1) and end + 1 < n and (caption(end + 1) or _is(w[end + 1], "social", "tax", "patient", "insurance", "chart", "passport", "licence", "ssn", "mrn") or len(_low(w[end + 1])) > 3 and w[end + 1][-1:] in "-‐–¬\xad" and any(x.startswith(_low(w[end + 1]).rstrip("-‐–¬")) for x in ("passport", "insurance", "social", "patient", "licence"))):
                while j < end and _low(w[j]) in _TITLES:
                    j += 1
                r.mark(j, end, "name")
                i = end
                continue
        elif near(low, "signed", 1) and t[-1:] != ":" and i >= 2:
            # "... Name and Name signed the ...": the names stand in front
            k, got = i, 0
            while k > 0 and got < 2:
                m = next((s for s in range(max(0, k - 4), k) if r.name(s) == k), None)
                if m is None:
                    break
                s = m
                while s < k and _low(w[s]) in _TITLES:
                    s += 1
                r.mark(s, k, "name")
                got += 1
                k = m
                if k >= 1 and (near(_low(w[k - 1]), "and", 1)) and got < 2:
                    k -= 1
                else:
                    break
        i += 1
    for i, end, kind in formats.values(w, line, lambda k: r.kind[k] is None):
        r.mark(i, end, kind)
    return r.kind


class Value(NamedTuple):
    """A run of words of one kind: their texts in reading order and their places on the page, -1 for a word of a neighbouring page."""

    kind: str
    words: list[str]
    places: list[int]


def page_runs(texts: list[str], y0: list[float], y1: list[float], own: dict, page: int, around: list[dict], tall: float | None = None, names: set[str] | frozenset[str] = frozenset()) -> list[Value]:
    """The personal values of a page: those of its body, which is read with the last lines of the page before and the first of the one behind, and
    those of each line in its margins. ``names`` are words of the page known for names."""
    near_ = {n["d"]: n for n in around}
    p = layout(texts, y0, y1, tall)
    kinds, body = margins(p, own, page, {d: n["outline"] for d, n in near_.items()})
    there = lambda lines, first: [(first + k, [(clean(t), -1) for t in l]) for k, l in enumerate(lines)]
    here = lambda k: (k, [(p.text[i], i) for i in p.lines[k]])
    parts = [[*there(lines_before(near_), -10), *map(here, body), *there(lines_behind(own, page, near_), len(p.lines))]]
    parts += [[here(k)] for k in range(len(p.lines)) if k not in set(body)]
    out: list[Value] = []
    for lines in parts:
        read = [(t, at, k) for k, l in lines for t, at in l if t]
        words = [t for t, _, _ in read]
        found = page_values(words, [k for _, _, k in read])
        named_words(words, found, names)
        for i, kind in enumerate(found):
            if kind is None:
                continue
            if not i or found[i - 1] != kind:
                out.append(Value(kind, [], []))
            out[-1].words.append(words[i])
            out[-1].places.append(read[i][1])
    return [v for v in out if any(k >= 0 for k in v.places)]


#: Occurrences of a word as a name from which, and share of all its occurrences above which, it is a name elsewhere.
TAUGHT, TAUGHT_SHARE = 3, 0.9
_NAME = re.compile(r"[^\W\d_]{3,}(['’-][^\W\d_]+)*")


def name_key(text: str) -> str | None:
    """The form under which a name is learnt: lower case, without signs around it; None for what is no name by its letters."""
    t = re.sub(r"['’]s$", "", _low(text))
    return t if _NAME.fullmatch(t) else None


def named_words(words: list[str], kinds: list[str | None], names: set[str] | frozenset[str]) -> None:
    """Marks known names that stand beside another capitalised word or initial, together with it: "Selma Corfold", "A. Corfold". A single one is
    left alone, as places and things are called by names too."""
    if not names:
        return
    known = lambda k: 0 <= k < len(words) and name_key(words[k]) in names
    ends = lambda k: _word(words[k])[-1:] in ".;:?!," and not _initial(words[k])
    for i, kind in enumerate(kinds):
        if kind is not None or not known(i) or not _named(words[i]):
            continue
        j = i + 1
        while j < len(words) and j <= i + 2 and kinds[j] is None and not ends(j - 1) and (known(j) and _named(words[j]) or _initial(words[j])):
            j += 1
        start = i
        while start > 0 and kinds[start - 1] is None and start > i - 2 and (_initial(words[start - 1]) or known(start - 1)) and not ends(start - 1):
            start -= 1
        before = words[start - 1] if start and kinds[start - 1] is None else ""
        if _word(before).endswith(",") and _named(before) and _low(before).upper() in before:
            start -= 1  # LAST, First
        elif j - start < 2 and j < len(words) and kinds[j] is None and not ends(i) and _named(words[j]) and len(_low(words[j])) > 3 and _word(words[j])[-1:] not in ":;" and _low(words[j]) not in _TITLES:
            j += 1
        if j - start >= 2:
            kinds[start:j] = ["name"] * (j - start)


_ARROW_TAGS = pa.list_(pa.struct([("word_id", pa.int64()), ("kind", pa.string()), ("name", pa.string())]))


@F.arrow_udf(from_arrow_type(_ARROW_TAGS))
def _tags(ids: pa.Array, texts: pa.Array, y0: pa.Array, y1: pa.Array, own: pa.Array, page: pa.Array, around: pa.Array, tall: pa.Array, names: pa.Array) -> pa.Array:
    out = []
    for i, t, a, b, o, p, n, h, k in zip(*(x.to_pylist() for x in (ids, texts, y0, y1, own, page, around, tall, names))):
        runs = page_runs(t, a, b, o, p, n or [], h, frozenset(k or ()))
        out.append([{"word_id": i[at], "kind": v.kind, "name": name_key(w) if v.kind == "name" else None} for v in runs for w, at in zip(v.words, v.places) if at >= 0])
    return pa.array(out, _ARROW_TAGS)


_READ = ("ids", "texts", "y0", "y1", "outline", "page", "around", "tall")
_BY = ["src", "file_id", "page"]


def taught_names(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """src, file_id, page, names: for each page the words on it that are known for names though nothing on the page says so.

    A word is known for a name if captions make it one at least TAUGHT times and in a share TAUGHT_SHARE of all its occurrences. Counts are
    combined before each shuffle; only pages that hold such a word beyond its marked occurrences come back.
    """
    taught = tags.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TAUGHT)
    key = F.regexp_replace(F.lower(F.regexp_replace("t", r"['’]s(?=[^\p{L}]*$)", "")), r"^[^\p{L}]+|[^\p{L}]+$", "")
    capital = F.filter("texts", lambda t: t.rlike(r"^[^\p{L}]*\p{Lu}"))
    seen = pages.select(*_BY, F.explode(capital).alias("t")).select(*_BY, key.alias("name")).groupBy(*_BY, "name").agg(F.count(F.lit(1)).alias("n"))
    marked = tags.where("name is not null").groupBy(*_BY, "name").agg(F.count(F.lit(1)).alias("m"))
    seen = seen.join(taught.select("name"), "name").join(marked, [*_BY, "name"], "left")
    total = seen.groupBy("name").agg(F.sum("n").alias("all"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("as_name")).where(F.col("as_name") >= TAUGHT_SHARE * F.col("all")).select("name")
    return seen.where("n > coalesce(m, 0)").join(total, "name").groupBy(*_BY).agg(F.collect_set("name").alias("names"))


def _read(words: DataFrame, sizes: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages in context, their tags by captions and formats, and the names taught."""
    pages = pages_in_context(words, sizes)
    tags = pages.select(*_BY, F.explode(_tags(*_READ, F.lit(None).cast("array<string>"))).alias("k")).select(*_BY, "k.*")
    tags = cut(tags)
    return pages, tags, cut(taught_names(pages, tags))


def personal_words(words: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """src, word_id, kind of every word of ``words`` (src, file_id, page, word_id, text, y0, y1) that is all or part of a personal value; ``sizes``
    (file_id, page, height) tells where the foot of a page is.

    Null and empty texts hold none; repeated rows count once; rows without word_id, file or page are left out; an empty table gives an
    empty result. Work is per page, so a file of any size is shared out; the few pages on which taught names stand are read once more.
    """
    pages, tags, taught = _read(words, sizes)
    again = pages.join(taught, _BY).select("src", F.explode(_tags(*_READ, "names")).alias("k")).select("src", "k.word_id", "k.kind")
    return tags.join(taught, _BY, "left_anti").select("src", "word_id", "kind").unionByName(again)


# -- redaction -------------------------------------------------------------------------------------------------------

_RIM = "\"'“”‘’«»„[]{}<>.,;:?! "


def redact_page(texts: list[str], order: list[int], runs: list[Value], key: bytes, dates: bool = True) -> str:
    """The texts in ``order`` with each value replaced by one placeholder, where it begins; what surrounds a value (quotes, closing signs)
    stays. The placeholder is that of the whole value, also where it runs over lines or a page break; of one begun on the page before nothing
    is left here."""
    instead: dict[int, str] = {}
    for v in runs:
        value = " ".join(v.words)
        core = value.strip(_RIM if v.kind != "phone" else _RIM.replace("[", "").replace("]", ""))
        head, _, tail = value.partition(core)
        instead |= {at: "" for at in v.places if at >= 0}
        if v.places[0] >= 0:
            instead[v.places[0]] = head + placeholder(v.kind, core, key) + (tail if v.places[-1] >= 0 else "")
    out = []
    for i in order:
        t = texts[i].strip()
        if i in instead:
            t = instead[i]
        elif dates and (core := t.strip(".,;:?!()[]")) and (swap := permute_date(core, key)):
            t = t.replace(core, swap)
        out.append(t)
    return " ".join(t for t in out if t)


def redacted_pages(words: DataFrame, key: str, sizes: DataFrame | None = None, dates: bool = True) -> DataFrame:
    """src, file_id, page, text, n_values: each page's text in reading order, line by line, with placeholders for personal values and
    keyed pseudonyms for numbers and (with ``dates``) dates. Equal values have equal placeholders throughout under one ``key``, which stays
    with the caller; n_values counts the values that begin on the page."""
    secret = key.encode()
    kind = pa.struct([("text", pa.string()), ("n_values", pa.int64())])

    def redact(texts: pa.Array, y0: pa.Array, y1: pa.Array, own: pa.Array, page: pa.Array, around: pa.Array, tall: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for t, a, b, o, p, n, h, k in zip(*(x.to_pylist() for x in (texts, y0, y1, own, page, around, tall, names))):
            runs = page_runs(t, a, b, o, p, n or [], h, frozenset(k or ()))
            order = [i for line in layout(t, a, b, h).lines for i in line]
            out.append({"text": redact_page(t, order, runs, secret, dates), "n_values": sum(v.places[0] >= 0 for v in runs)})
        return pa.array(out, kind)

    pages, _, taught = _read(words, sizes)
    made = F.arrow_udf(redact, from_arrow_type(kind))
    return pages.join(taught, _BY, "left").select(*_BY, made(*_READ[1:], "names").alias("r")).select(*_BY, "r.*")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_words(all_words(spark, sf_dir), page_sizes(spark, sf_dir))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of the session's setting leafspan.pseudonym.key, and one that is drawn for this run where none is set."""
    return redacted_pages(all_words(spark, sf_dir), spark.conf.get("leafspan.pseudonym.key", None) or secrets.token_hex(16), page_sizes(spark, sf_dir))


QUERIES = {"p5_found": found, "p5_redacted": redacted}
ORACLE: dict[str, str] = {}

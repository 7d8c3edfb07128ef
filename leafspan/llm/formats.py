"""Personal values told by their published formats alone, without a caption: numbering plans, identity numbers with their ranges and check
digits, postal addresses. Values may be written in one word or in several."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

_RIM = "\"'“”‘’«»„[]{}<>.,;:?!"
#: Calling codes of one and two digits (all others have three).
_CODES_1, _CODES_2 = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Words in front of a number that make it the number of a thing.
_NUMBER = {"no", "nr", "num", "number"}
_THING = {"part", "item", "order", "invoice", "lot", "batch", "model", "ref", "reference", "serial", "article", "form"}
_STREET = re.compile(r"(?i)^(street|st|avenue|ave|road|rd|lane|ln|way|court|ct|crescent|terrace|blvd|boulevard|drive|dr|place|pl|square)$")
#: Postal codes of states, districts and territories.
_STATES = set("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP".split())


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit() and c.isascii())


def luhn(digits: str) -> bool:
    """Whether the last digit of a card number is its check digit."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def card(text: str) -> bool:
    """A number of a payment card: 13 to 19 digits in groups, check digit right."""
    d = digits_of(text)
    return bool(re.fullmatch(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -]?)\d{6}\2\d{5}", text)) and 13 <= len(d) <= 19 and d[0] in "3456" and luhn(d)


def social(text: str) -> bool:
    """A social security number, or an individual tax number, by its ranges: area, group and serial are never all zero, 666 is no area."""
    m = re.fullmatch(r"(\d{3})([- ])(\d{2})\2(\d{4})", text)
    return bool(m) and m[1] not in ("000", "666") and m[3] != "00" and m[4] != "0000"


def insurance(text: str) -> bool:
    """A national insurance number: two letters of those in use, six digits, a letter of A to D."""
    t = text.replace(" ", "")
    return bool(re.fullmatch(r"[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z]\d{6}[A-D]", t)) and t[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def health(text: str) -> bool:
    """A health service number: ten digits as 3-3-4, weighted sum modulo 11."""
    if not re.fullmatch(r"\d{3} \d{3} \d{4}", text):
        return False
    d = [int(c) for c in digits_of(text)]
    check = 11 - sum((10 - i) * x for i, x in enumerate(d[:9])) % 11
    return check % 11 == d[9] and check != 10


def iban(text: str) -> bool:
    """An account number: country, check digits, up to 30 signs, 1 modulo 97."""
    t = text.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", t):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def country_code(digits: str) -> int:
    """How many digits of an international number are its calling code."""
    return 1 if digits[:1] in _CODES_1 else 2 if digits[:2] in _CODES_2 else 3


@lru_cache(1 << 16)
def phone(text: str) -> bool:
    """A telephone number that its form alone tells: international with a calling code, or national with its area code."""
    t = re.sub(r"(?i)\s*(x|ext\.?)\s*\d{1,5}$", "", text)
    d = digits_of(t)
    if re.fullmatch(r"\+\d[\d ().-]{6,18}", t):
        return 8 <= len(d) <= 15
    return bool(re.fullmatch(r"(1[-. ])?(\([2-9]\d{2}\) ?|[2-9]\d{2}([-.]))\d{3}[-.]\d{4}", t))


@lru_cache(1 << 16)
def email(text: str) -> bool:
    return bool(re.fullmatch(r"[\w.+-]+@[\w-]+(\.[\w-]+)*\.[A-Za-z]{2,}", text))


def idno(text: str) -> bool:
    return social(text) or insurance(text) or card(text) or health(text) or iban(text)


@lru_cache(1 << 17)
def _core(text: str) -> str:
    return text.strip(_RIM)


@lru_cache(1 << 17)
def _opens(text: str) -> bool:
    """Whether a word can be the first of a number: the words of running text can't."""
    return bool(re.match(r"[\"'“”‘’«»„\[{<]*(\+?\(?\d|[A-Z]{2}\d*[A-D]?[\"'“”‘’«»„\]}>.,;:?!]*$)", text))


def _thing(words: list[str], i: int) -> bool:
    """Whether the words in front make a number that of a thing: "part no. 334-..."; an abbreviation does, as it may be a misread one."""
    if not i:
        return False
    before = words[i - 1]
    low = _core(before).lower()
    return low in _NUMBER or low in _THING or low.startswith("#") or i > 1 and len(low) <= 3 and _core(words[i - 2]).lower() in _THING or len(low) <= 3 and before.rstrip(")]\"'").endswith((".", ":")) and not low.startswith(("tel", "ph"))


def _street_address(w: list[str], i: int, free: Callable[[int], bool]) -> int:
    """End of an address that begins with a house number at ``i``: street, then unit, town, state and postal code; without a state and a
    postal code only behind a word that says where somebody lives."""
    n = len(w)
    if not re.fullmatch(r"\d{1,5}[A-Za-z]?", _core(w[i])) or w[i][-1:] in ".;:?!":
        return i
    j = i + 1
    while j < min(i + 5, n) and free(j) and w[j][:1].isupper() and not _STREET.match(_core(w[j])):
        j += 1
    if not (i + 1 < j < n and free(j) and _STREET.match(_core(w[j]))):
        return i
    end = j + 1
    for k in range(end, min(end + 6, n - 1)):
        if _core(w[k]) in _STATES and re.fullmatch(r"\d{5}(-\d{4})?", _core(w[k + 1])):
            return k + 2
        if not (w[k][:1].isupper() or w[k][:1] in "#" or w[k][:1].isdigit()):
            break
    lives = i > 1 and _core(w[i - 1]).lower() in ("at", "in", "is") and re.fullmatch(r"(?i)(live[sd]?|living|resid(es?|ed|ing)|address|home|house|stay(s|ed|ing)?|moved)", _core(w[i - 2]))
    if not lives:
        return i
    while w[end - 1].endswith(",") and end < n and free(end) and w[end][:1].isupper():
        end += 1
    return end


def values(words: list[str], line: list[int], free: Callable[[int], bool]) -> Iterator[tuple[int, int, str]]:
    """(first word, end, kind) of the values that their formats tell among the words that are ``free``. Numbers of several words stay on a line."""
    i, n = 0, len(words)
    while i < n:
        w = words[i]
        if free(i) and "@" in w and email(_core(w)):
            yield i, i + 1, "email"
        elif free(i) and _opens(w):
            longest = None
            for j in range(i + 1, min(i + 8, n) + 1):
                if j - 1 > i and not (free(j - 1) and line[j - 1] == line[i] and re.search(r"\d|^[A-Z]{1,4}\W*$", words[j - 1])):
                    break
                text = " ".join(words[i:j]).lstrip(_RIM).rstrip(_RIM)
                if idno(text):
                    longest = j, "idno"
                elif phone(text) and (text[0] in "+(" or not _thing(words, i)):
                    longest = j, "phone"
                if words[j - 1][-1:] in ",;:?!":
                    break
            if longest is None and (end := _street_address(words, i, free)) > i:
                longest = end, "address"
            if longest is not None:
                yield i, *longest
                i = longest[0]
                continue
        i += 1

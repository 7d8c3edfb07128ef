"""Keyed pseudonyms that keep the format of a value: a Feistel network permutes the digits of validated numbers and the days of dates.

What a format fixes stays as it is: calling code, area code and extension mark of a telephone number, issuer of a card, letters of an identity
number, signs and groups of all. What it derives is derived anew: check digits. Numbers that a format forbids are walked past, so a
pseudonym is as valid as its value. Equal values have equal pseudonyms under one key, in whatever groups they are written.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable
from datetime import date, timedelta

from leafspan.llm import formats


def _round(key: bytes, label: str, i: int, half: str) -> int:
    return int.from_bytes(hmac.new(key, f"{label}|{i}|{half}".encode(), hashlib.sha256).digest()[:16], "big")


def permute_digits(digits: str, key: bytes, label: str, back: bool = False, rounds: int = 10) -> str:
    """Another string of as many digits: a Feistel network over its two halves, a permutation of all such strings."""
    if len(digits) < 2:
        d = int(digits or 0)
        shift = _round(key, label, 0, "") % 10
        return str((d - shift if back else d + shift) % 10) if digits else ""
    m = len(digits) // 2
    a, b = digits[:m], digits[m:]
    for i in range(rounds - 1, -1, -1) if back else range(rounds):
        if i % 2 == 0:
            b = str((int(b) + (-1 if back else 1) * _round(key, label, i, a)) % 10 ** len(b)).zfill(len(b))
        else:
            a = str((int(a) + (-1 if back else 1) * _round(key, label, i, b)) % 10 ** len(a)).zfill(len(a))
    return a + b


def walk(digits: str, key: bytes, label: str, valid: Callable[[str], bool], back: bool = False) -> str:
    """The permutation restricted to the valid strings: walks on while the result is none. ``digits`` is valid itself, so the walk ends."""
    while True:
        digits = permute_digits(digits, key, label, back)
        if valid(digits):
            return digits


# -- dates -----------------------------------------------------------------------------------------------------------

_FIRST, _LAST = date(1900, 1, 1), date(2099, 12, 31)
_MONTHS = "January February March April May June July August September October November December".split()
#: (pattern, order of its three numbers); two digits of a year stand for 2000 to 2099.
_FORMS = (
    (re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"), "y-md"),
    (re.compile(r"(\d{1,2})(/)(\d{1,2})\2(\d{4}|\d{2})"), "m-dy"),
    (re.compile(r"(\d{1,2})([.])(\d{1,2})\2(\d{4}|\d{2})"), "d-my"),
    (re.compile(r"(\d{1,2})(-)(\d{1,2})\2(\d{4}|\d{2})"), "m-dy"),
)


def _in(n: int, first: date, last: date, key: bytes, label: str, back: bool) -> int:
    days = (last - first).days + 1
    return int(walk(str(n).zfill(len(str(days))), key, label, lambda d: int(d) < days, back))


def permute_date(text: str, key: bytes, back: bool = False) -> str | None:
    """Another valid date of the same format, or None for what is no date from 1900 to 2099.

    The formats are YYYY-MM-DD, M/D/YYYY, D.M.YYYY, M-D-YYYY, also with years of two digits (2000 to 2099), with or without leading zeros; a value
    of the second and fourth whose first number is above 12 is read day first. Padding stays: a number with a leading zero, or of two digits in a
    date that has one, keeps two; others are written as they come.
    """
    for pattern, order in _FORMS:
        if not (m := pattern.fullmatch(text)):
            continue
        numbers, sign = [m[1], m[3], m[4]], m[2]
        names = order.replace("-", "")
        if names == "mdy" and int(numbers[0]) > 12:
            names = "dmy"
        at = dict(zip(names, numbers))
        short = len(at["y"]) == 2
        zero, wide = any(at[k][0] == "0" for k in "md"), len(at["m"] + at["d"]) == 4
        # how it looks: with padding, with two numbers of two digits anyhow, or bare; each look is permuted within itself
        look = "padded" if zero or wide and names == "ymd" else "wide" if wide else "bare"
        try:
            day = date(int(at["y"]) + 2000 * short, int(at["m"]), int(at["d"]))
        except ValueError:
            return None
        first, last = (date(2000, 1, 1), date(2099, 12, 31)) if short else (_FIRST, _LAST)
        if not first <= day <= last:
            return None
        n = (day - first).days
        while True:
            n = _in(n, first, last, key, f"date{names}{sign}{short}{look}", back)
            new = first + timedelta(days=n)
            same = (new.month >= 10 and new.day >= 10) == (look == "wide") or names == "ymd" and look == "padded"
            if same and (names != "dmy" or sign == "." or new.day > 12):
                break
        width = 2 if look == "padded" else 1
        parts = {"y": f"{new.year % 100:02d}" if short else f"{new.year:04d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
        return sign.join(parts[k] for k in names)
    return None


# -- numbers ---------------------------------------------------------------------------------------------------------


def _filled(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() and c.isascii() else c for c in value)


def _card_check(body: str) -> str:
    return next(c for c in "0123456789" if formats.luhn(body + c))


def _health_check(body: str) -> str | None:
    check = 11 - sum((10 - i) * int(c) for i, c in enumerate(body)) % 11
    return None if check == 10 else str(check % 11)


def permute_number(kind: str, value: str, key: bytes, back: bool = False) -> str:
    """The pseudonym of a telephone or identity number in the format of ``value``."""
    d = formats.digits_of(value)
    if kind == "phone":
        number = re.split(r"(?i)\s*(?:x|ext\.?)\s*(?=\d{1,5}$)", value)[0]
        own = formats.digits_of(number)
        rest = d[len(own):]
        # calling code and area code stay; the last seven digits, or what there are, are the subscriber's
        fixed = formats.country_code(own) if number.lstrip("( ").startswith("+") else 0
        fixed = max(fixed, len(own) - 7) if len(own) > 7 else fixed
        head, body = own[:fixed], own[fixed:]
        exchange = body[:1] not in ("0", "1")
        body = walk(body, key, f"phone{len(body)}{exchange}", lambda x: (x[:1] not in ("0", "1")) == exchange, back) if body else body
        return _filled(value, head + body + (permute_digits(rest, key, f"ext{len(rest)}", back) if rest else ""))
    if formats.social(value):
        tax = d[0] == "9"
        ok = lambda x: x[:3] not in ("000", "666") and x[3:5] != "00" and x[5:] != "0000" and (x[0] == "9") == tax
        return _filled(value, walk(d, key, f"social{tax}", ok, back))
    if formats.card(value):
        return _filled(value, d[:6] + (b := permute_digits(d[6:-1], key, f"card{len(d)}", back)) + _card_check(d[:6] + b))
    if formats.health(value):
        body = walk(d[:9], key, "health", lambda x: _health_check(x) is not None, back)
        return _filled(value, body + _health_check(body))
    if formats.iban(value):
        t = value.replace(" ", "")
        inner = formats.digits_of(t[4:])
        body = _filled(t[4:], permute_digits(inner, key, f"iban{t[:2]}{len(inner)}", back))
        check = 98 - int("".join(str(int(c, 36)) for c in body + t[:2] + "00")) % 97
        return _filled(value, f"{check:02d}" + formats.digits_of(body))
    return _filled(value, permute_digits(d, key, f"{kind}{len(d)}", back))


def canonical(value: str) -> str:
    """What links values that are written in other cases, signs, lines or forms of a letter."""
    return "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if c.isalnum() or c in "@.+")


def placeholder(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a value: telephone and identity numbers with their permuted number, others with a token of 128 bits."""
    if kind in ("phone", "idno") and formats.digits_of(value):
        return f"[{kind.upper()} {permute_number(kind, value, key)}]"
    token = hmac.new(key, f"{kind}|{canonical(value)}".encode(), hashlib.sha256).hexdigest()[:32]
    return f"[{kind.upper()} {token}]"

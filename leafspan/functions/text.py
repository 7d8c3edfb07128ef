"""Text of words as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs taken off a word before it is looked up, and those ignored when two texts are compared.
EDGE_SIGNS = ".,;:!?()[]{}\"'"
COMPARE_SIGNS = ".:,"
VOWELS = "aeiouAEIOU"


def normalised(t: Column) -> Column:
    return F.lower(F.trim(t))


def normalised_letters(t: Column) -> Column:
    """Lower case, trimmed, without punctuation."""
    return F.trim(F.regexp_replace(F.lower(t), r"[^\w\s]", ""))


def strip_edges(t: Column, unicode: bool = True) -> Column:
    """Without signs that are no word characters at either end."""
    return F.regexp_replace(t, ("(?U)" if unicode else "") + r"^[^\w]+|[^\w]+$", "")


def core_of(t: Column) -> Column:
    """Without EDGE_SIGNS at either end."""
    return F.btrim(t, F.lit(EDGE_SIGNS))


def prefix_of(t: Column) -> Column:
    return F.substr(t, F.lit(1), F.length(t) - F.length(F.ltrim(t, F.lit(EDGE_SIGNS))))


def suffix_of(t: Column) -> Column:
    """The signs behind the core; empty where a text has no core at all."""
    kept = F.ltrim(t, F.lit(EDGE_SIGNS))
    return F.right(kept, F.length(kept) - F.length(F.rtrim(kept, F.lit(EDGE_SIGNS))))


def compare_key(t: Column) -> Column:
    return F.btrim(F.lower(t), F.lit(COMPARE_SIGNS))


def digit_ratio(t: Column) -> Column:
    """Share of digits; 0 for an empty text."""
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit(r"\d")) / F.length(t)).otherwise(0.0)


def punctuation_only(t: Column) -> Column:
    """Whether a text has only punctuation and white space; true for an empty one."""
    return t.rlike(r"^[\p{Punct}\s]*$")


def garbage(t: Column, min_alnum: float = 0.6, consonants: int = 4) -> Column:
    """Whether a text looks like noise: too short, too few letters and digits, a long run of consonants, or capitals and
    small letters mixed inside. Addresses of mail and web are exempt."""
    exempt = t.contains("@") | t.contains(".com") | t.contains(".org")
    alnum = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) / F.length(t)
    run = t.rlike(r"[\p{L}&&[^" + VOWELS + "]]{" + str(consonants) + ",}")
    inner = F.substr(t, F.lit(2), F.length(t) - 2)
    mixed = (F.length(t) > 3) & inner.rlike(r"\p{Lu}") & inner.rlike(r"\p{Ll}")
    return F.when(F.length(t) < 2, True).when(exempt, False).otherwise((alnum < min_alnum) | run | mixed)


def title_case(t: Column) -> Column:
    """A capital at the start of every run of letters, small letters otherwise ("hello-world" gives "Hello-World")."""
    pieces = F.regexp_extract_all(t, F.lit(r"[A-Za-z\p{L}]+|[^A-Za-z\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def like_case(target: Column, model: Column) -> Column:
    """``target`` in the case of ``model``: upper, lower, title, or else as it is."""
    cased = model.rlike(r"\p{L}")
    return (
        F.when(cased & (F.upper(model) == model), F.upper(target))
        .when(cased & (F.lower(model) == model), F.lower(target))
        .when(cased & (title_case(model) == model), title_case(target))
        .otherwise(target)
    )


def tokens(t: Column) -> Column:
    """Words between white space, with their punctuation."""
    return F.filter(F.split(t, r"[ \t\n\r\f]+"), lambda x: x != "")


def word_at(line: Column, rel: Column) -> Column:
    """The word of a text line at relative position ``rel`` (0..1): words and single spaces share the width by their letters."""
    words = tokens(line)
    total = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) + F.size(words) - 1
    at = F.floor(rel * total)
    state = F.aggregate(
        words,
        F.struct(F.lit(0).alias("end"), F.lit(None).cast("string").alias("word")),
        lambda s, w: F.struct((s["end"] + F.length(w) + 1).alias("end"), F.when(s["word"].isNull() & (s["end"] + F.length(w) >= at), w).otherwise(s["word"]).alias("word")),
    )
    return F.coalesce(state["word"], F.element_at(words, -1))


def concatenated(t: Column, others: Column, times: float = 1.5) -> Column:
    """Whether a text without spaces is more than ``times`` as long as one of the other readings."""
    return ~t.contains(" ") & F.exists(others, lambda o: (F.length(o) > 0) & (F.length(t) > F.lit(times) * F.length(o)))


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)

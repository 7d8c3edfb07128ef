"""Problem 9: texts decoded with the wrong character encoding.

Every distinct clean word of the corpus, and every distinct run of letters outside ASCII, is put through all encoding chains;
the garbled forms make a table that is hash-joined with the corpus vocabulary and through it with the documents' words.
A form counts as garbled where the word it comes from is commoner than the form itself (more than twice, so that nothing depends on absolute
counts): in the same language for chains between single-byte encodings, whose output can be proper text of another language (forms of four characters on in the whole
corpus, too), and in the whole corpus for chains that read UTF-8 bytes, whose output never is. A document without a language has the one that
most of its words are from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspan.session import cut
from leafspan.sources import table

#: Single-byte encodings by the script they are for.
ENCODINGS = {
    "western": ("cp1252", "latin-1", "mac_roman", "cp437", "cp850"),
    "central": ("cp1250", "iso8859-2", "cp852"),
    "turkish": ("cp1254", "iso8859-9", "cp857"),
    "cyrillic": ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"),
}
#: Encodings that programs take for granted wherever a text comes from.
TAKEN = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
#: Encodings that UTF-8 bytes are wrongly read with, and those that they are read with twice.
UTF8_READ_AS = tuple(dict.fromkeys([*TAKEN, *ENCODINGS["central"], "koi8-r", "cp866", "cp1254"]))
TWICE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254")
#: (written in, read as) of single-byte encodings: any of a script read as another of it, or as one that is taken for granted.
BYTE_SWAPS = tuple((w, r) for own in ENCODINGS.values() for w in own for r in dict.fromkeys([*own, *TAKEN]) if r != w)
#: Encodings whose bytes are read as UTF-8, with U+FFFD for what makes no character.
LOSSY_FROM = ("cp1252", "cp1250", "iso8859-2", "cp1251", "cp1254", "koi8-r")
#: A word with signs outside ASCII: tried once where it begins, without turning back.
UNIT = r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f][^\x00-\x40\x5b-\x60\x7b-\x7f]*"
RUN = r"[^\x00-\x7f]+"
LOST = "�"
FORMS = T.StructType([T.StructField(n, k) for n, k in (("lang", T.StringType()), ("form", T.StringType()), ("word", T.StringType()), ("n_word", T.LongType()))])


def _read(data: bytes, encoding: str) -> str:
    """``data`` read in ``encoding``; bytes it has no sign for become the control characters of their number."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)


def lossy_forms(word: str) -> set[str]:
    """What ``word`` turns into when its bytes in a single-byte encoding are read as UTF-8."""
    out = set()
    for write in LOSSY_FROM:
        try:
            out.add(word.encode(write).decode("utf-8", "replace"))
        except UnicodeEncodeError:
            pass
    return out - {word}


def run_forms(run: str) -> set[str]:
    """The garbled forms that a run outside ASCII has whatever word it stands in."""
    return utf8_forms(run) | lossy_forms(run)


def utf8_forms(word: str) -> set[str]:
    """What ``word`` turns into when its UTF-8 bytes are read in a wrong encoding, once or twice."""
    data, out = word.encode("utf-8", "ignore"), set()
    for e in UTF8_READ_AS:
        once = _read(data, e)
        out |= {once}
        if e in TWICE:
            out |= {_read(once.encode("utf-8"), e)}
    out |= {_read(_read(data, "latin-1").encode("utf-8"), "cp1252")}
    return out - {word}


def byte_forms(word: str) -> set[str]:
    """What ``word`` turns into between single-byte encodings, or when single bytes are read as UTF-8."""
    out = set()
    for write, read in BYTE_SWAPS:
        try:
            out.add(_read(word.encode(write), read))
        except UnicodeEncodeError:
            pass
    return (out | lossy_forms(word)) - {word}


def garbles_to(word: str, form: str) -> bool:
    """Whether ``word`` turns into ``form`` by the chains, put through them once or twice; parts of a word that has runs of its own can go
    through different chains."""
    once = utf8_forms(word) | byte_forms(word)
    if form in once or any(form in utf8_forms(x) or form in byte_forms(x) for x in once):
        return True
    old, new = re.split(f"({RUN})", word), re.split(f"({RUN})", form)
    return len(old) == len(new) > 3 and all(a == b or a and b and garbles_to(a, b) for a, b in zip(old, new))


@F.arrow_udf(T.BooleanType())
def _verified(words: pa.Array, forms: pa.Array) -> pa.Array:
    return pa.array([None if w is None else garbles_to(w, f) for w, f in zip(words.to_pylist(), forms.to_pylist())], pa.bool_())


def _all_forms(make) -> object:
    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(lang, f, w, n) for lang, w, n in zip(b["lang"], b["word"], b["n"]) if LOST not in w for f in make(w)]
            yield pd.DataFrame(rows, columns=["lang", "form", "word", "n_word"])

    return forms


def _dominant(forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lang, form, word: forms that occur, with the commonest word that is commoner than the form."""
    seen = vocabulary.select("lang", F.col("word").alias("form"), F.col("n").alias("n_form"))
    return forms.join(seen, ["lang", "form"]).where(F.col("n_word") > 2 * F.col("n_form")).groupBy("lang", "form").agg(F.max(F.struct("n_word", "word"))["word"].alias("word"))


def words_of(docs: DataFrame, key: str, text: str, lang: str | None) -> DataFrame:
    """doc, lang, word: the distinct words outside ASCII of every document; lang '' where it is null or undetermined."""
    code = F.lower(F.trim(F.col(lang))) if lang else F.lit("")
    code = F.when(code.isNull() | (code == "und"), "").otherwise(code)
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)))
    return docs.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("doc"), code.alias("lang"), F.explode(found).alias("word"))


def told_languages(open_: DataFrame, by_lang: DataFrame) -> DataFrame:
    """doc, told: the language that most of a document's words are from, for the documents of ``open_``; each word counts for its
    languages by their shares of it in ``by_lang``. Documents without a word that a document with a language has are left out."""
    n = by_lang.where("lang <> ''").select("word", F.col("lang").alias("told"), "n")
    share = n.join(n.groupBy("word").agg(F.sum("n").alias("all")), "word").select("word", "told", (F.col("n") / F.col("all")).alias("share"))
    votes = open_.select("doc", "word").join(share, "word").groupBy("doc", "told").agg(F.round(F.sum("share"), 6).alias("votes"))
    return votes.groupBy("doc").agg(F.max(F.struct("votes", "told"))["told"].alias("told"))


def words_in_languages(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``words`` with the told language where a document has none, and lang, word, n: in how many documents of a language a word is."""
    by_lang = cut(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    open_ = words.where("lang = ''")
    told = cut(open_.join(told_languages(open_, by_lang), "doc", "left").select("doc", F.coalesce("told", "lang").alias("lang"), "word"))
    counts = by_lang.where("lang <> ''").unionByName(told.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    return words.where("lang <> ''").unionByName(told), cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))


def garbled_words(by_lang: DataFrame) -> DataFrame:
    """lang, word, original, proof: the garbled words of the vocabulary ``by_lang`` (lang, word, n); original is null where signs are lost,
    and only words with proof make a document garbled."""
    overall = by_lang.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit("*").alias("lang"), "word", "n")
    vocabulary = by_lang.where("lang <> ''").unionByName(overall).where(F.col("word").rlike(r"[\p{L}\ufffd]"))
    byte_level = _dominant(vocabulary.mapInPandas(_all_forms(byte_forms), FORMS), vocabulary)

    runs = overall.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)))).alias("word"), "n").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    run_level = _dominant(runs.mapInPandas(_all_forms(run_forms), FORMS), runs).select(F.col("form").alias("run"), F.col("word").alias("to"))

    distinct = by_lang.select("lang", "word")
    own = distinct.join(byte_level.where("lang <> '*'").select("lang", F.col("form").alias("word"), F.col("word").alias("own")), ["lang", "word"], "left")
    # a longer word may also be told from the whole corpus, whatever language its document claims
    anywhere = byte_level.where((F.col("lang") == "*") & ((F.length("form") >= 4) | F.col("form").contains(LOST))).select(F.col("form").alias("word"), F.col("word").alias("anywhere"))
    by_byte = own.join(anywhere, "word", "left").select("lang", "word", F.coalesce("own", "anywhere").alias("byte_word"))
    pieces = distinct.select("lang", "word", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)))).alias("run")).join(run_level, "run")
    # longer runs first: a shorter one may be part of them
    swaps = pieces.groupBy("lang", "word").agg(F.array_sort(F.collect_list(F.struct((-F.length("run")).alias("by"), "run", "to"))).alias("swaps"))
    swapped = F.aggregate("swaps", F.col("word"), lambda t, s: F.replace(t, s["run"], s["to"]))
    by_run = swaps.select("lang", "word", swapped.alias("run_word"))
    lost = F.col("word").contains(LOST)
    both = by_byte.join(by_run, ["lang", "word"], "left").where(F.col("byte_word").isNotNull() | F.col("run_word").isNotNull())
    # a single sign can be a proper letter or symbol of its own: it is put back, but proves nothing
    letters = F.length("word") > 1, F.col("word").rlike(r"^\p{L}$") & F.col("byte_word").rlike(r"^\p{L}$")
    both = both.where(F.col("run_word").isNotNull() | letters[0] | letters[1])
    first = both.select("lang", "word", F.when(~lost, F.coalesce("run_word", "byte_word")).alias("original"), (lost | F.col("run_word").isNotNull() | letters[0]).alias("proof"))
    again = first.select("lang", F.col("word").alias("original"), F.col("original").alias("deeper"))
    deep = first.join(again, ["lang", "original"], "left").select("lang", "word", F.coalesce("deeper", "original").alias("original"), "proof")
    # what does not turn into the form again is not put in its place
    return deep.withColumn("original", F.when(_verified("original", "word"), F.col("original")))


def garbled_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """doc, word, original, proof of every garbled word of every document; a document without proof is not garbled.

    Null, empty and ASCII texts have none; repeated rows give one row per key and word; texts of any length are read
    whole; without ``lang`` the corpus is taken as one language. The vocabulary is joined by hash and never sent to the driver.
    """
    words, by_lang = words_in_languages(cut(words_of(docs, key, text, lang)))
    return words.join(garbled_words(by_lang), ["lang", "word"]).select("doc", "word", "original", "proof").distinct()


def repair_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """key, repaired, n_garbled, n_lost of every document with garbled words: its text with the originals put in place.

    Words that have lost signs (U+FFFD), and those whose original does not turn into them again, stay as they are and are counted in n_lost.
    """
    bad = garbled_documents(docs, key, text, lang).groupBy("doc").agg(F.collect_list(F.struct("word", "original")).alias("swaps"), F.max("proof").alias("proof")).where("proof")
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("_text")).dropDuplicates(["doc"])
    return source.join(bad, "doc").select(F.col("doc").alias(key), _put_back("_text", "swaps").alias("repaired"), F.size("swaps").cast("bigint").alias("n_garbled"), F.size(F.filter("swaps", lambda s: s["original"].isNull())).cast("bigint").alias("n_lost"))


@F.arrow_udf(T.StringType())
def _put_back(texts: pa.Array, swaps: pa.Array) -> pa.Array:
    unit = re.compile(UNIT)
    out = []
    for t, s in zip(texts.to_pylist(), swaps.to_pylist()):
        to = {x["word"]: x["original"] for x in s if x["original"] is not None}
        out.append(unit.sub(lambda m: to.get(m[0], m[0]), t))
    return pa.array(out, pa.string())


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(_documents(spark, sf_dir)).where("proof").select(F.col("doc").alias("doc_id")).distinct()


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_documents(_documents(spark, sf_dir))


QUERIES = {"p9_found": found, "p9_repaired": repaired}
ORACLE: dict[str, str] = {}

"""Problem 3: freely typed values mapped to the entries of a reference list.

The entries' keys (lower case, without accents and without anything but letters and digits) stand in a BK-tree under the
Levenshtein distance, the beginnings that abbreviate them in another. A list of at most SHARD entries goes to every task; a longer one
is cut into shards that stay on the executors: values and shards meet block by block, each shard gives its winner, and the winners merge.
Both ways give the same result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.bktree import BKTree, levenshtein
from leafspan.session import cut
from leafspan.sources import table

#: Entries of one tree, which is also the most that is sent to every task; and the distinct values that one task looks up in one shard.
SHARD, BLOCK = 50_000, 100_000
#: A prefix is taken for an abbreviation from this many letters on.
LEAST_PREFIX = 4
#: Keys whose winners a worker remembers.
MEMO = 1 << 18
_TRAILING = " \t\r\n)]}>\"'”’*;:,!?-"
#: What a shard says of a value: its nearest entry (ten per edit, then the edits with accents, then the id), and how many entries the value
#: abbreviates, with and without regard to accents, and the least of them.
WINNER = "cost bigint, fine bigint, id bigint, short bigint, short_id bigint, plain bigint, plain_id bigint"
_FIELDS = [x.split()[0] for x in WINNER.split(", ")]
_ARROW = pa.struct([(n, pa.int64()) for n in _FIELDS])


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def key_of(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalnum()).lower()


def limit_of(key: str) -> int:
    """Edits allowed: none up to 3 letters, one up to 5, two beyond."""
    return 0 if len(key) <= 3 else 1 if len(key) <= 5 else 2


class Matcher:
    """The winner of one shard for each value; with ``alone``, no other shard's winner is to be compared with it."""

    def __init__(self, entries: list[tuple[int, str]], alone: bool = False):
        self.alone = alone
        self.by_key: dict[str, list[tuple[int, str]]] = {}
        for i, t in entries:
            if key := key_of(t):
                self.by_key.setdefault(key, []).append((i, folded(t)))
        self.tree = BKTree(list(self.by_key))
        self.beginnings: BKTree | None = None
        self.near: dict[str, list[tuple[int, str]]] = {}
        self.begun: dict[str, list[str]] = {}

    def _nearest(self, keys: list[str]) -> None:
        """Remembers (distance, entry key) of every entry within the limit of each key."""
        new = [k for k in dict.fromkeys(keys) if k not in self.near]
        found: dict[str, list[tuple[int, str]]] = {k: [] for k in new}
        # an entry's own key is nearest to itself: no search can better it
        for k in new:
            if k in self.by_key:
                found[k].append((0, k))
        rest = [k for k in new if not found[k]]
        q, e, d = self.tree.search(rest, np.array([limit_of(k) for k in rest], np.int64))
        for a, b, x in zip(q.tolist(), e.tolist(), d.tolist()):
            found[rest[a]].append((x, self.tree.entries.values[b]))
        self.near |= found

    def _abbreviated(self, keys: list[str]) -> None:
        """Remembers the entry keys that begin with each key: those that hang on the tree of beginnings at distance 0."""
        new = [k for k in dict.fromkeys(keys) if k not in self.begun]
        if not new:
            return
        if self.beginnings is None:
            self.heads: dict[str, list[str]] = {}
            for k in self.by_key:
                for n in range(LEAST_PREFIX, len(k) + 1):
                    self.heads.setdefault(k[:n], []).append(k)
            self.beginnings = BKTree(list(self.heads))
        self.begun |= {k: [] for k in new}
        q, e, _ = self.beginnings.search(new, np.zeros(len(new), np.int64))
        for a, b in zip(q.tolist(), e.tolist()):
            self.begun[new[a]] = self.heads[self.beginnings.entries.values[b]]

    def match(self, values: list[str]) -> list[tuple[int | None, ...]]:
        if len(self.near) > MEMO:
            self.near, self.begun = {}, {}
        forms: dict[str, list[str]] = {}
        values = [v.strip() for v in values]
        for v in dict.fromkeys(values):
            forms[v] = [key_of(v)]
            head, comma, rest = v.rstrip(_TRAILING).partition(",")
            if comma and rest.strip():  # "splint, twin ..." stands for "twin ... splint"
                forms[v].append(key_of(rest + head))
        self._nearest([k for ks in forms.values() for k in ks if k])
        short = {v: ks[0] for v, ks in forms.items() if len(ks[0]) >= LEAST_PREFIX and v.rstrip(_TRAILING).endswith(".")}
        self._abbreviated(list(short.values()))
        won: dict[str, tuple[int | None, ...]] = {}
        for v, ks in forms.items():
            near = [x for k in ks if k for x in self.near[k]]
            least = min((d for d, _ in near), default=None)
            own = folded(v)
            nearest = [x for d, k in near if d == least for x in self.by_key[k]]
            sole = self.alone and len(nearest) == 1
            best = min(((10 * least, 0 if sole or own == f else levenshtein(own, f), i) for i, f in nearest), default=(None, None, None))
            entries = [x for k in self.begun[short[v]] for x in self.by_key[k]] if v in short else []
            exact, plain = {i for i, f in entries if f.startswith(own)}, {i for i, _ in entries}
            won[v] = (*best, len(exact), min(exact, default=None), len(plain), min(plain, default=None))
        return [won[v] for v in values]


_matchers: OrderedDict[bytes, Matcher] = OrderedDict()


def _searcher(entries: list[tuple[int, str]]):
    """The look-up in a list that travels with the function; a worker keeps the trees of the last few lists, told by a digest of their content."""
    mark = hashlib.sha256(repr(entries).encode("utf-8", "surrogatepass")).digest()

    def search(values: pa.Array) -> pa.Array:
        if mark not in _matchers:
            _matchers[mark] = Matcher(entries, alone=True)
            while len(_matchers) > 4:
                _matchers.popitem(last=False)
        won = _matchers[mark].match([v or "" for v in values.to_pylist()])
        return pa.array([dict(zip(_FIELDS, w)) for w in won], _ARROW)

    return F.arrow_udf(search, WINNER)


def _in_shards(values: DataFrame, entries: DataFrame, shards: int, block: int) -> DataFrame:
    """_value and its _won over all shards: each shard meets each block of values in a task of its own."""
    blocks = max(1, -(-values.count() // block))
    v = values.withColumn("_block", F.pmod(F.xxhash64("_value"), F.lit(blocks))).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    e = entries.withColumn("_shard", F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def look_up(v: pa.Table, e: pa.Table) -> pa.Table:
        texts = v["_value"].to_pylist()
        won = Matcher(list(zip(e["i"].to_pylist(), e["t"].to_pylist()))).match(texts)
        return pa.table({"_value": pa.array(texts, pa.string())} | {n: pa.array([w[k] for w in won], pa.int64()) for k, n in enumerate(_FIELDS)})

    won = v.groupBy("_shard", "_block").cogroup(e.groupBy("_shard", "_block")).applyInArrow(look_up, f"_value string, {WINNER}")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("cost", "fine", "id")))
    return won.groupBy("_value").agg(first.alias("f"), *[F.sum(n).alias(n) for n in ("short", "plain")], *[F.min(n).alias(n) for n in ("short_id", "plain_id")]).select("_value", F.struct("f.cost", "f.fine", "f.id", "short", "short_id", "plain", "plain_id").alias("_won"))


def _blank(value: str) -> Column:
    return F.col(value).isNull() | (F.trim(F.regexp_replace(F.col(value), r"\s+", " ")) == "")


def map_to_list(values: DataFrame, entries: DataFrame, value: str, entry_id: str, entry: str, out: str = "entry_id", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``values`` with ``out``: the id of the entry meant, or -1 for none.

    An entry with the value's own key wins, then a unique abbreviation (a beginning of an entry, closed by a full stop; told apart by accents
    if it has to be), then the smallest distance within the limit for the key's length; ties go to the entry nearest in spelling with
    accents, then to the smallest id. An abbreviation of several entries stands for none unless an entry is near. Null and blank values have
    null; entries with null or blank text or null id match nothing; an empty list gives -1 throughout; a column of ``values`` that is named
    as ``out`` is replaced.

    A list of at most ``shard`` entries is looked up row by row, without a shuffle. A longer one is counted, never collected: distinct values
    meet each of its shards, in blocks of about ``block``, and the winners are joined back; a value that fills many rows makes one task there,
    and its rows are split over tasks by the adaptive join.
    """
    listed = entries.select(F.col(entry_id).cast("bigint").alias("i"), F.col(entry).alias("t")).where("i is not null and trim(t) <> ''").distinct()
    head = listed.limit(shard + 1).collect()
    if len(head) <= shard:
        won = values.withColumn("_won", _searcher(sorted((r["i"], r["t"]) for r in head))(F.col(value)))
    else:
        listed = cut(listed)
        asked = cut(values.where(~_blank(value)).select(F.col(value).alias("_value")).distinct())
        won = values.join(_in_shards(asked, listed, -(-listed.count() // shard), block), F.col(value) == F.col("_value"), "left").drop("_value")
    w = F.col("_won")
    meant = F.when(w["cost"] == 0, w["id"]).when(w["short"] == 1, w["short_id"]).when(w["plain"] == 1, w["plain_id"]).otherwise(w["id"])
    return won.withColumn(out, F.when(~_blank(value), F.coalesce(meant, F.lit(-1).cast("bigint")))).drop("_won")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sanitize_results").select("result_id", "original_text").where(~_blank("original_text")).distinct()
    return map_to_list(rows, table(spark, sf_dir, "dict_terms"), "original_text", "term_id", "term", "term_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("result_id", "term_id")


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that stand for no entry, with how often they occur."""
    return _mapped(spark, sf_dir).where("term_id = -1").groupBy(F.trim("original_text").alias("value")).agg(F.count(F.lit(1)).alias("results"))


QUERIES = {"p3_found": found, "p3_unmatched": unmatched}
_KEY = "regexp_replace(strip_accents(lower({0})), '[^a-z0-9]', '', 'g')"
_MATCH = f"""
WITH v AS (SELECT DISTINCT result_id, original_text FROM sanitize_results WHERE trim(original_text, E' \\t\\r\\n') <> ''),
u AS (SELECT DISTINCT trim(original_text, E' \\t\\r\\n') AS t FROM v),
stripped AS (SELECT t, rtrim(t, E' \\t\\r\\n)]}}>"''”’*;:,!?-') AS s FROM u),
forms AS (SELECT t, s, {_KEY.format("t")} AS k, 0 AS turned FROM stripped
  UNION ALL SELECT t, s, {_KEY.format("substr(s, strpos(s, ',') + 1) || split_part(s, ',', 1)")}, 1 FROM stripped WHERE strpos(s, ',') > 0 AND trim(substr(s, strpos(s, ',') + 1)) <> ''),
terms AS (SELECT term_id, lower(term) AS f, {_KEY.format("term")} AS k FROM dict_terms),
near AS (SELECT f.t, d.term_id, 10 * levenshtein(f.k, d.k) AS cost, d.f AS df FROM forms f JOIN terms d
  ON abs(length(f.k) - length(d.k)) <= 2 AND levenshtein(f.k, d.k) <= CASE WHEN length(f.k) <= 3 THEN 0 WHEN length(f.k) <= 5 THEN 1 ELSE 2 END WHERE f.k <> ''),
best AS (SELECT t, arg_min(term_id, cost * 1000000000 + levenshtein(regexp_replace(lower(t), '[[:punct:][:space:]]', '', 'g'), regexp_replace(df, '[[:punct:][:space:]]', '', 'g')) * 1000000 + term_id) AS term_id, min(cost) AS cost FROM near GROUP BY t),
short AS (SELECT f.t, count(DISTINCT d.term_id) AS n, min(d.term_id) AS term_id,
    count(DISTINCT d.term_id) FILTER (starts_with(regexp_replace(d.f, '[[:punct:][:space:]]', '', 'g'), regexp_replace(lower(f.t), '[[:punct:][:space:]]', '', 'g'))) AS n2,
    min(d.term_id) FILTER (starts_with(regexp_replace(d.f, '[[:punct:][:space:]]', '', 'g'), regexp_replace(lower(f.t), '[[:punct:][:space:]]', '', 'g'))) AS id2
  FROM forms f JOIN terms d ON starts_with(d.k, f.k) WHERE turned = 0 AND s LIKE '%.' AND length(f.k) >= {LEAST_PREFIX} GROUP BY f.t),
chosen AS (SELECT u.t, CASE WHEN b.cost = 0 THEN b.term_id WHEN s.n2 = 1 THEN s.id2 WHEN s.n = 1 THEN s.term_id WHEN b.term_id IS NOT NULL THEN b.term_id ELSE -1 END AS term_id
  FROM u LEFT JOIN best b USING (t) LEFT JOIN short s USING (t))
"""
ORACLE = {
    "p3_unmatched": _MATCH + "SELECT trim(v.original_text, ' ') AS value, count(*) AS results FROM v JOIN chosen c ON trim(v.original_text, E' \\t\\r\\n') = c.t WHERE term_id = -1 GROUP BY 1",
    "p3_found": _MATCH + "SELECT v.result_id, c.term_id FROM v JOIN chosen c ON trim(v.original_text, E' \\t\\r\\n') = c.t",
}

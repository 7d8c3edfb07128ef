"""Encoding with a public byte-level tokenizer file through the tokenizers library, over Arrow batches."""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("LEAFSPAN_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: Bytes of spans and ids kept per worker before the cache starts afresh; bounds memory, not what is encoded.
CACHE_BYTES = 64 << 20

_UNITS = re.compile(r"\S+(?: \S+)*|\s+")
_PIECES = re.compile(r" ?[^ ]*?[,.:](?=[0-9])| ?[^ ]+")
#: White space to Python but not to the tokenizer's splitting pattern: texts with these are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_loaded: dict[str, "ByteEncoder"] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for U+0100 onwards in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = itertools.count(256)
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


def splits_before_merging(file: dict) -> bool:
    """Whether a tokenizer file (as read from JSON) splits texts at white space and before digits behind punctuation, changes nothing before that, and
    merges bytes within the splits only."""
    pre = file.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    byte_level = [s for s in steps if s.get("type") == "ByteLevel"]
    return file.get("normalizer") is None and len(steps) == len(byte_level) == 1 and byte_level[0].get("use_regex", True) and not byte_level[0].get("add_prefix_space", False) and (file.get("model") or {}).get("type") == "BPE"


class ByteEncoder:
    """Ids of texts under one tokenizer file.

    A byte-level tokenizer splits a text before it merges bytes, and never merges across a split. So the ids of a text
    are those of its spans, where a span ends at a split that its neighbours can't change: between white space
    and text (one plain space goes with the text behind it) and between punctuation and a digit. Each span is
    encoded once by the library and kept; subtitles repeat theirs a great deal.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Whether the file splits texts as the spans assume; texts are encoded whole where it doesn't.
        self.splits = splits_before_merging(json.loads(self.tokenizer.to_str()))
        self.kept = 0
        self.spans: dict[str, bytes] = {}
        self.gaps: dict[str, tuple[bytes, str]] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.spans.__getitem__, pieces))
        except KeyError:
            new = [p for p in dict.fromkeys(pieces) if p not in self.spans]
            made = self._whole(new)
            self.kept += sum(len(p) + len(b) + 200 for p, b in zip(new, made))  # and what Python needs for them
            self.spans.update(zip(new, made))
            return b"".join(map(self.spans.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian int32 bytes."""
        if not text:
            return b""
        if not self.splits or _ODD_SPACE.search(text):
            return self._whole([text])[0]
        if self.kept > CACHE_BYTES:
            self.kept = 0
            self.spans.clear()
            self.gaps.clear()
        spans, gaps, out, lead = self.spans, self.gaps, [], ""
        units = _UNITS.findall(text)
        closing = units.pop() if units[-1].isspace() else ""
        for i in range(bool(units) and units[0].isspace(), len(units), 2):  # words and white space take turns
            if i:
                gap = units[i - 1]
                if gap not in gaps:
                    gaps[gap] = self._gap(gap)
                got, lead = gaps[gap]
                out.append(got)
            u = lead + units[i]
            got = spans.get(u)
            if got is None:
                got = self._pieces(_PIECES.findall(u))
                if "-->" not in u:  # cue times hardly ever come again
                    spans[u] = got
                    self.kept += len(u) + len(got) + 200
            out.append(got)
        if closing:
            out.append(self._pieces([closing]))
        return b"".join(out)

    def _gap(self, gap: str) -> tuple[bytes, str]:
        """White space with words behind it: all but its last sign is a piece; a plain space leads the next words."""
        lead = " " if gap[-1] == " " else ""
        parts = [p for p in (gap[:-1], "" if lead else gap[-1]) if p]
        return (self._pieces(parts) if parts else b""), lead

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, bytes]:
        """Offsets and ids of a batch; null and empty texts have none."""
        found = [self.ids(t) if t else b"" for t in texts.to_pylist()]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(b) // 4 for b in found], out=offsets[1:])
        return offsets, b"".join(found)


def encoder(path: str) -> ByteEncoder:
    if path not in _loaded:
        _loaded[path] = ByteEncoder(path)
    return _loaded[path]


def tokenizer_path(name: str = DEFAULT, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.json")


def ids_of(text: F.Column, path: str) -> F.Column:
    """ARRAY<INT> of the ids of a text column; an empty array for empty and null texts."""

    def encode(texts: pa.Array) -> pa.Array:
        offsets, ids = encoder(path).arrays(texts)
        values = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))(text)


def token_count(text: F.Column, path: str) -> F.Column:
    """BIGINT number of tokens of a text column; 0 for empty and null texts."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.diff(encoder(path).arrays(texts)[0]).astype(np.int64))

    return F.arrow_udf(count, T.LongType())(text)


def offsets_of(text: F.Column, path: str) -> F.Column:
    """ARRAY<STRUCT<id, start, end>>: each token with the characters [start, end) of the text it comes from, in code points.

    The tokens of a character that is split over several tokens all carry that character's place."""

    def encode(texts: pa.Array) -> pa.Array:
        enc = encoder(path).tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return pa.array([[{"id": i, "start": a, "end": b} for i, (a, b) in zip(e.ids, e.offsets)] for e in enc], kind)

    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    place = T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "start", "end")])
    return F.arrow_udf(encode, T.ArrayType(place))(text)


def text_of(ids: F.Column, path: str) -> F.Column:
    """STRING of an ids column: the tokens' bytes by the reversed byte table, decoded once over the whole row, so that
    characters split over tokens come together again. Null ids give null; bytes that make no character give U+FFFD."""

    def decode(rows: pa.Array) -> pa.Array:
        if path not in _bytes:
            back = {c: b for b, c in byte_alphabet().items()}
            t = encoder(path).tokenizer
            _bytes[path] = [bytes(back[c] for c in t.id_to_token(i)) if all(c in back for c in t.id_to_token(i)) else t.id_to_token(i).encode() for i in range(t.get_vocab_size())]
        table = _bytes[path]
        return pa.array([None if r is None else b"".join([table[i] for i in r]).decode("utf-8", "replace") for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(decode, T.StringType())(ids)


_bytes: dict[str, list[bytes]] = {}

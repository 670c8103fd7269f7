"""Byte-level BPE encoding and decoding with the tiktoken library and a local file of ranks.

Long texts are split before encoding at places where the pre-tokenizer's matches end whatever follows: between a
character that isn't white space and white space. A segment (white space, then other characters) is therefore encoded
on its own with the same ids, and frequent segments are encoded once per task. Runs of white space beyond
LONG_RUN overflow the library's regex stack; such a run is one match but for its last character, so it is encoded as
one piece.

Null texts count as empty and give no ids. Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import frugal, slices

#: Unicode's White_Space, the pre-tokenizer's \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1000
#: A task remembers so many segments of so many characters at most; when that is full, the older half goes.
MEMO, MEMO_CHARS = 100_000, 64

_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_BEFORE = re.compile(f"[{SPACE}] ")
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
_BUILT: dict = {}


class Codec:
    """Encodes texts to ids and ids to bytes. ranks: the lines of a rank file (base64 of a token, its rank)."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.splitlines()))}
        self._library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self._memo, self._old, self._tails, self._old_tails = {}, {}, {}, {}

    def _ids(self, segment: str) -> bytes:
        found = self._old.get(segment) or array("i", self._library.encode_ordinary(segment)).tobytes()
        if len(segment) <= MEMO_CHARS:
            if len(self._memo) >= MEMO:
                self._memo, self._old = {}, self._memo
            self._memo[segment] = found
        return found

    def _tail(self, word: str) -> bytes:
        """The ids of a space and the word, kept under the word."""
        found = self._old_tails.get(word) or array("i", self._library.encode_ordinary(" " + word)).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self._tails) >= MEMO:
                self._tails, self._old_tails = {}, self._tails
            self._tails[word] = found
        return found

    def _segments(self, text: str) -> bytes:
        if _BEFORE.search(text):  # a space after white space: only the general rule is safe
            get, own = self._memo.get, self._ids
            return b"".join([get(s) or own(s) for s in _SEGMENT.findall(text)])
        first, *rest = text.split(" ")
        get, own = self._tails.get, self._tail
        return self._ids(first) + b"".join([get(w) or own(w) for w in rest])

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text, special tokens' strings being ordinary text."""
        if len(text) < LONG_RUN or not (runs := list(_RUN.finditer(text))):
            return np.frombuffer(self._segments(text), dtype=np.int32)
        parts, at = [], 0
        for run in runs:
            parts.append(self._segments(text[at : run.start()]))
            at = run.end() - (run.end() < len(text))
            piece = text[run.start() : at].encode()
            parts.append(array("i", self._library._encode_single_piece(piece)).tobytes())
        return np.frombuffer(b"".join([*parts, self._segments(text[at:])]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, which need not be UTF-8."""
        return self._library.decode_bytes(ids.tolist())


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each rank file and pattern in a process."""
    key = (hash(ranks), len(ranks), pattern)
    if key not in _BUILT:
        _BUILT[key] = Codec(ranks, pattern)
    return _BUILT[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the column ids (array of int) added, replacing any of that name.

    rank_file is read on the driver and broadcast (a vocabulary, about 1 MB for 50,000 tokens). decoded: also add a
    binary column of that name with the bytes that the ids decode to."""
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c not in (ids, decoded)]
    field = docs.schema[text]
    if not isinstance(field.dataType, T.StringType):
        raise TypeError(f"{text} isn't a string column")
    source = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([*(source.schema[c] for c in rest), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for whole in batches:
            for batch in slices(whole, text):
                found = [own.encode(t or "") for t in batch.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int32), type=pa.int32())
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, *schema.names[len(rest) :]])
        own.forget()  # the codec stays with the worker

    return source.mapInArrow(frugal(run), schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """tokens with a binary column of the bytes that the ids stand for (null ids: none), replacing any of that name."""
    with open(rank_file, "rb") as f:
        ranks = tokens.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in tokens.columns if c != decoded]
    source = tokens.select(*(F.col(f"`{c}`") for c in rest))
    schema = T.StructType([*(source.schema[c] for c in rest), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            out = [own.decode(np.asarray(x or [], dtype=np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*rest, decoded])

    return source.mapInArrow(run, schema)

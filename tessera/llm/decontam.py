"""Benchmark decontamination: a BM25 index of test items, queried with every passage of every document.

Terms are pairs of neighbouring words (lower case, runs of word characters). Items are the indexed documents; an
item's scores are divided by what it scores itself, so one threshold fits all lengths. Documents are cut into passages
of twice the longest item, each beginning half a passage after the one before, so every copy lies whole in one. A
passage is a query of its distinct terms: block-max WAND walks the terms' postings and evaluates only items whose
bounds, first by term and then by block of BLOCK items, can reach RETRIEVE. Every item above it is verified word by
word: of the question (all but the last sentences) and of the answer (the last sentences, a fifth of the words at
least) OVERLAP must be found in the passage in order.

The index is broadcast whole if its items have at most PART_BYTES, else in parts of about that size, and documents are read
once for each part. Counts, mean length and passages are those of the whole benchmark, so parts change no result. Items of fewer than two words match nothing; null texts count as empty; repeated items count once; rows
with repeated or null ids are each judged.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, frugal, slices

RETRIEVE, OVERLAP, BLOCK, PART_BYTES = 0.5, 0.8, 16, 8 << 20
K1, B = 1.2, 0.75

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words, cut before its last sentences; one sentence is all question."""
    parts = [w for w in (words(p) for p in re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    total, answer = sum(map(len, parts)), []
    while len(parts) > 1 and len(answer) * 5 < total:
        answer = parts.pop() + answer
    return [w for p in parts for w in p], answer


def _items(items: list[tuple]) -> list[tuple]:
    """Items of two words and more, repeated ones once, in order."""
    seen: dict[tuple, None] = {}
    for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        if len(words(text)) > 1:
            seen.setdefault((item_id, text))
    return list(seen)


class Statistics(NamedTuple):
    """Of a whole benchmark: items, their words, the longest's words, and items by pair of words (joined by a space)."""

    n: int
    words: int
    longest: int
    df: dict[str, int]


def statistics_of(runs: list[list[str]]) -> Statistics:
    return Statistics(len(runs), sum(map(len, runs)), max(map(len, runs), default=1), Counter(t for r in runs for t in {f"{a} {b}" for a, b in pairwise(r)}))


class Index:
    """Postings of the items: (item, impact) by item, impacts divided by the item's own score. whole: the statistics of all
    items, if these are a part."""

    def __init__(self, items: list[tuple], whole: Statistics | None = None):
        self.items = [(i, *question_and_answer(t)) for i, t in _items(items)]
        runs = [q + a for _, q, a in self.items]
        whole = whole or statistics_of(runs)
        self.vocabulary: dict[str, int] = {}
        for run in runs:
            for w in run:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        size = max(1, len(self.vocabulary))
        pairs = [Counter(self.vocabulary[a] * size + self.vocabulary[b] for a, b in pairwise(r)) for r in runs]
        df = {self.vocabulary[a] * size + self.vocabulary[b]: whole.df[f"{a} {b}"] for r in runs for a, b in pairwise(r)}
        n, mean = whole.n, whole.words / max(1, whole.n)
        self.terms = np.array(sorted(df), dtype=np.int64)
        place = {t: k for k, t in enumerate(self.terms.tolist())}
        postings: list[list[tuple[int, float]]] = [[] for _ in place]
        for d, own in enumerate(pairs):
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(runs[d]) / mean)) for t, f in own.items()}
            total = math.fsum(impact.values())
            for t, x in impact.items():
                postings[place[t]].append((d, x / total))
        self.postings = postings
        self.most = np.array([max(x for _, x in p) for p in postings] or [0.0])
        self.blocks = [{} for _ in postings]
        for k, p in enumerate(postings):
            for d, x in p:
                self.blocks[k][d // BLOCK] = max(x, self.blocks[k].get(d // BLOCK, 0.0))
        self.span = 2 * whole.longest

    def passages(self, run: list[str]) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, distinct terms) of each passage whose terms' largest impacts could reach the threshold."""
        if len(run) < 2 or not len(self.terms):
            return
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in run], dtype=np.int64)
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.vocabulary) + ids[1:], -1)
        at = np.minimum(np.searchsorted(self.terms, pair), len(self.terms) - 1)
        hit = self.terms[at] == pair
        if not hit.any():
            return
        sums = np.concatenate([[0.0], np.cumsum(np.where(hit, self.most[at], 0.0))])
        starts = np.arange(0, max(1, len(run) - self.span // 2), self.span // 2)
        ends = np.minimum(starts + self.span, len(run))
        for k in np.flatnonzero(sums[ends - 1] - sums[starts] >= RETRIEVE - 1e-9).tolist():
            a, b = int(starts[k]), int(ends[k])
            yield a, b, np.unique(at[a : b - 1][hit[a : b - 1]]).tolist()

    def search(self, terms: list[int], least: float = RETRIEVE) -> list[tuple[int, float]]:
        """(item, score) of every item that scores least or more: block-max WAND."""
        least -= 1e-9
        out: list[tuple[int, float]] = []
        end = len(self.items)
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]  # item, place in its postings, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                after = (block + 1) * BLOCK  # nothing of these terms in this block reaches it; a later term might start before its end
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                self._advance(cursors, pivot, max(after, item + 1), end)
            elif cursors[0][0] == item:
                score = math.fsum(self.postings[t][at][1] for _, at, t in cursors[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                self._advance(cursors, pivot, item + 1, end)
            else:
                self._advance(cursors, pivot, item, end)
        return out

    def _advance(self, cursors: list, pivot: int, to: int, end: int) -> None:
        """Moves the first cursors to the first item at or after `to`; spent ones go."""
        for c in cursors[: pivot + 1]:
            postings, at = self.postings[c[2]], c[1]
            while at < len(postings) and postings[at][0] < to:
                at += 1
            c[0], c[1] = (postings[at][0], at) if at < len(postings) else (end, at)
        cursors[:] = [c for c in cursors if c[0] < end]

    def verify(self, run: list[str], item: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's words that the passage has in order."""
        _, question, answer = self.items[item]
        matched = np.zeros(len(question) + len(answer), bool)
        for m in SequenceMatcher(None, question + answer, run, autojunk=False).get_matching_blocks():
            matched[m.a : m.a + m.size] = True
        q = float(matched[: len(question)].mean())
        return q, float(matched[len(question) :].mean()) if answer else q

    def hits(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """item: (score, question overlap, answer overlap) of all verified items of the text, by their best passage."""
        run = words(text)
        best: dict[int, tuple[float, float, float]] = {}
        for a, b, terms in self.passages(run):
            for item, score in self.search(terms):
                q, w = self.verify(run[a:b], item)
                if min(q, w) >= OVERLAP:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, w))
        return best


def _parts(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """The benchmark's index, in parts of bounded size with the statistics of the whole."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // PART_BYTES) or 1
    if n == 1:
        yield Index([(r.i, r.t) for r in items.collect()])
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                runs = [[w for part in question_and_answer(t) for w in part] for t in batch.column(1).to_pylist()]
                pairs = [sorted({f"{a} {b}" for a, b in pairwise(r)}) for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array(map(len, runs), pa.int64()), pa.array(pairs, pa.list_(pa.string())), batch.column(2)], names=["words", "pairs", "part"])

    items = cut(items.distinct().withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("long")))
    known = cut(items.select("i", "t", "part").mapInArrow(run, "words long, pairs array<string>, part long").where("words > 1"))
    each = known.agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.max("words").alias("l")).first()
    pairs = cut(known.select("part", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("df"), F.collect_set("part").alias("parts")))
    for k in range(n):
        df = {r.pair: r.df for r in pairs.where(F.array_contains("parts", k)).select("pair", "df").collect()}  # of one part's items
        yield Index([(r.i, r.t) for r in items.where(F.col("part") == k).collect()], Statistics(each.n, each.w or 0, each.l or 1, df))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair."""
    source = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([source.schema[doc_id], T.StructField(item_id, benchmark.schema[item_id].dataType), *(T.StructField(c, T.DoubleType(), False) for c in ("score", "question_overlap", "answer_overlap"))])
    out = None
    for index in _parts(benchmark, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for whole in batches:
                for batch in slices(whole, "_text"):
                    rows: dict[str, list] = defaultdict(list)
                    at = []
                    for i, t in enumerate(batch.column(1).to_pylist()):
                        for item, (score, q, a) in sorted(own.hits(t).items()):
                            at.append(i)
                            for name, value in zip(schema.names[1:], (own.items[item][0], score, q, a), strict=True):
                                rows[name].append(value)
                    if at:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(rows[item_id]), *(pa.array(rows[c], pa.float64()) for c in schema.names[2:])], names=schema.names)

        found = source.mapInArrow(frugal(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found."""
    for index in _parts(benchmark, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for whole in batches:
                for batch in slices(whole, text):
                    yield batch.filter(pa.array([not own.hits(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs

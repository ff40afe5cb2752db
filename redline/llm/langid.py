"""Language spans by script ranges and Viterbi.

Each run of letters is a word. Its script narrows the languages to those that were
seen in that script; hashed letter trigrams give the word a log-probability per
candidate; Viterbi over the words, with a penalty for each switch, labels spans of
mixed text. A document's language is the one with most letters in its spans.

Where the best single language cannot be improved by any switch (no stretch of words
prefers another one by more than half the penalty) the path is that language, and
only other documents are walked word by word; both give the same path.

Defined results: null texts and texts without a letter are `und` with score 0; with
no training rows every text is `und`; ties go to the first language by code point. Rows of
the same id are rows of their own. Only doc_id, text and lang are read, so other columns may
have any name. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import arrow_schema, fold

#: Documents per language that the trigrams are learned from, at most (expected; drawn by hash of the id).
TRAIN_DOCS = 3_000
BUCKETS, PENALTY, BLOCK = 1 << 16, 12.0, 1 << 20

# Scripts by their main Unicode ranges.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case if it is a letter, else 0; its script's number, 0 for others."""
    low, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (one := chr(c)).isalpha():
            small = one.lower()
            low[c] = ord(small) if len(small) == 1 else c
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a:b + 1] = k
    return low, script


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a separator, and where each text starts."""
    joined = "\n" + "\n".join(texts) + "\n"
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), at


def trigrams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and the bucket of the trigram around each; what is no letter is a boundary."""
    low = letters()[0][cp]
    where = np.flatnonzero(low)
    h = low[where - 1] * np.uint32(0x9E3779B1) ^ low[where] * np.uint32(0x85EBCA77) ^ low[where + 1] * np.uint32(0xC2B2AE3D)
    return where, (h * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK code points."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # languages x buckets, log-probabilities
    allowed: np.ndarray  # scripts x languages

    def words(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: starts and ends of its words in code points, and their scores per language."""
        cp, at = points(texts)
        where, bucket = trigrams(cp)
        first = np.flatnonzero(np.diff(where, prepend=-1) > 1)
        starts, ends = where[first], where[np.append(first[1:], len(where)) - 1] + 1 if len(where) else where
        score = np.empty((len(first), len(self.langs)))
        allowed = self.allowed[letters()[1][cp[starts]]]
        for k in range(len(self.langs)):
            if len(first):
                score[:, k] = np.add.reduceat(self.weight[k][bucket].astype(np.float64), first)
        score[~allowed] -= 50.0
        cut = np.searchsorted(starts, at)
        for k in range(len(texts)):
            a, b = cut[k], cut[k + 1]
            yield starts[a:b] - at[k], ends[a:b] - at[k], score[a:b]

    def path(self, score: np.ndarray) -> np.ndarray:
        """The best language of each word, a switch costing PENALTY."""
        best = int(score.sum(0).argmax())
        gain = np.cumsum(score - score[:, best:best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
        if (gain - low).max() <= PENALTY / 2:
            return np.full(len(score), best)
        n, count = score.shape
        come = np.empty((n, count), np.int32)
        now = score[0].copy()
        same = np.arange(count)
        for t in range(1, n):
            top = int(now.argmax())
            stay = now >= now[top] - PENALTY
            come[t] = np.where(stay, same, top)
            now = np.where(stay, now, now[top] - PENALTY) + score[t]
        out = np.empty(n, np.int64)
        out[-1] = now.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = come[t, out[t]]
        return out

    def label(self, starts: np.ndarray, ends: np.ndarray, score: np.ndarray) -> tuple[str, float, list[tuple[str, int, int]]]:
        if not len(starts) or not self.langs:
            return "und", 0.0, []
        path = self.path(score)
        mass = np.bincount(path, ends - starts, len(self.langs))
        turn = np.flatnonzero(np.diff(path, prepend=-1))
        last = np.append(turn[1:], len(path)) - 1
        spans = [(self.langs[path[a]], int(starts[a]), int(ends[b])) for a, b in zip(turn, last, strict=True)]
        top = int(mass.argmax())
        return self.langs[top], float(mass[top] / mass.sum()), spans


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) of docs (lang, text): letter trigrams, and letters per script after the buckets."""
    size = BUCKETS + len(SCRIPTS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                for lang in sorted(set(langs[a:b])):
                    cp, _ = points([t for t, own in zip(texts[a:b], langs[a:b], strict=True) if own == lang])
                    where, bucket = trigrams(cp)
                    got = sums.setdefault(lang, np.zeros(size, np.int64))
                    got += np.bincount(bucket, minlength=size)
                    got[BUCKETS:] += np.bincount(letters()[1][cp[where]], minlength=len(SCRIPTS) + 1)
        for lang, n in sums.items():
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on), pa.array(n[on])], schema=arrow_schema(counted))

    counted = "lang string,bucket long,n long"
    return docs.mapInArrow(run, counted).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """From docs (doc_id, text, lang): rows of the training folds with a language."""
    own = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(fold(F.col("doc_id"), 4) != 2)
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_docs / n)))
    rows = count_trigrams(own.where(keep).select("lang", "text")).toPandas()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 1))
    counts[rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weight = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed = (share >= 0.001).T
    allowed[~allowed.any(1)] = True  # a script not learned rules nobody out
    return Model(langs, weight, allowed)


SCHEMA = "doc_id long,lang_pred string,score double,spans string"


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans as lang:start:end in code points) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                rows = [own.label(*w) for w in own.words(texts[a:b])]
                said = [",".join(f"{x}:{s}:{e}" for x, s, e in r[2]) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.float64()), pa.array(said, pa.string())], schema=arrow_schema(SCHEMA))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    out = label_documents(docs, fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "spans")

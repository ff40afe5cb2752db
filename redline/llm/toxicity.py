"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, from the
stretches of a bounded labelled sample that are typical of their class: byte fragments
that the likelihood ratio puts on one side, by the texts that hold them or by those that
repeat them every EVERY bytes (near copies in the sample count once). Every document is
cut into windows; each window is compressed with both dictionaries, and the difference of
the two lengths says which one explains it better. The dictionaries are used as plain
content with literals left as they are, so that a length differs only where a window
repeats something a dictionary holds. How a document's differences make a score is
calibrated by logistic regression on rows that the dictionaries have not seen: each third
of the sample meets dictionaries of the other two.

Defined results: null and empty texts get the score of a text without windows;
without labels of both classes every score is the share of toxic labels (0 if none). Rows of
the same id are scored each by its own text; a score of exactly one half counts as toxic.
Only doc_id, text and toxic are read, so other columns may have any name. An empty table
gives an empty result."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import fold, map_rows

#: Labelled rows of each class that are fitted on, at most (expected; drawn by hash of the id).
TRAIN_ROWS = 2_000
FRAGMENT, WINDOW, DICTIONARY = 5, 256, 1024
#: A fragment is dense in a text that holds it at least once in so many bytes.
EVERY = 1000
#: Bytes of one labelled text that are fitted on, at most: pieces spread over the whole text.
SAMPLE_BYTES, PIECE = 1 << 15, 1 << 11


def normal(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode().lower().split()) + b" "


def windows(line: bytes, size: int = WINDOW) -> list[bytes]:
    """The line in pieces of about `size` bytes, cut at blanks."""
    out, at = [], 0
    while at < len(line) - 1:
        end = line.find(b" ", at + size)
        end = len(line) - 1 if end < 0 else end
        out.append(line[at:end + 1])
        at = end
    return out


def one_of_copies(lines: list[bytes]) -> list[bytes]:
    """One line of those that share the smallest hash of their three-word shingles."""
    seen: dict[int, bytes] = {}
    for line in lines:
        words = line.split()
        key = min(xxhash.xxh64_intdigest(b" ".join(words[k:k + 3])) for k in range(max(1, len(words) - 2)))
        seen.setdefault(key, line)
    return list(seen.values())


def fragments(line: bytes) -> tuple[set[bytes], set[bytes]]:
    """The fragments of the line, and those that it holds at least once in EVERY bytes."""
    counts = Counter(line[k:k + FRAGMENT] for k in range(len(line) - FRAGMENT + 1))
    held = {f: n for f, n in counts.items() if b" " not in f[1:-1]}
    return set(held), {f for f, n in held.items() if n * EVERY >= len(line)}


def typical(own: Counter, other: Counter, n: int, m: int, least: int = 3, ratio: float = 20.0, times: float = 8.0) -> set[bytes]:
    """Fragments of at least `least` own documents whose likelihood ratio exceeds
    `ratio` and which are `times` as frequent as in the other class."""
    p, out = n / (n + m), set()
    for f, c in own.items():
        d = other.get(f, 0)
        if c < least or c / n <= times * d / m:
            continue
        total = c + d
        if 2 * (c * math.log(c / total / p) + (d * math.log(d / total / (1 - p)) if d else 0.0)) > ratio:
            out.add(f)
    return out


def stretches(line: bytes, marks: set[bytes]) -> bytes:
    """The parts of the line that marked fragments cover."""
    cover = bytearray(len(line))
    for k in range(len(line) - FRAGMENT + 1):
        if line[k:k + FRAGMENT] in marks:
            cover[k:k + FRAGMENT] = b"\1" * FRAGMENT
    out, at = [], 0
    while (at := cover.find(1, at)) >= 0:
        end = cover.find(0, at)
        end = len(line) if end < 0 else end
        out.append(line[at:end])
        at = end
    return b"\n".join(out)


def dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if s]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, total // 4)), samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return (b"\n".join(samples) + b"\n" * 64)[:DICTIONARY]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    # the fast strategy with a target length leaves literals as they are
    way = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=FRAGMENT, window_log=17, hash_log=14,
                                              write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=way)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=way)


def features(pair: tuple, line: bytes) -> list[float]:
    own, other = pair
    gain = np.array([len(other.compress(w)) - len(own.compress(w)) for w in windows(line)] or [0])
    over = gain >= 3
    return [gain.mean(), gain.max(), over.mean(), math.log1p(over.sum()), math.log1p((gain >= 6).sum()), math.log1p(len(gain)), gain.min()]


def dictionaries(sides: list[list[bytes]], counts: list[tuple[Counter, Counter]]) -> tuple[bytes, bytes]:
    """One of each side's lines; `counts` tells in how many lines of the side a fragment is held, and dense."""
    marked = []
    for k, (own, other) in enumerate((counts, counts[::-1])):
        n, m = len(sides[k]), len(sides[1 - k])
        marks = typical(own[0], other[0], n, m) | typical(own[1], other[1], n, m)
        marked.append(dictionary([stretches(line, marks) for line in sides[k]]))
    return marked[0], marked[1]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    share: float = 0.0

    def scorer(self):
        if self.weights is None:
            return lambda text: self.share
        pair = compressor(self.toxic), compressor(self.ordinary)

        def score(text: str | None) -> float:
            x = (np.array(features(pair, normal(text))) - self.mean) / self.scale
            return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))
        return score


def train(toxic: list[bytes], ordinary: list[bytes], odds: float | None = None) -> Model:
    """From the normal lines of the two classes, each in a fixed order; `odds` of toxic
    to ordinary rows where the model is used (those of the lines, if not given)."""
    n, m = len(toxic), len(ordinary)
    sides = [one_of_copies(toxic), one_of_copies(ordinary)]
    if min(map(len, sides)) < 3:
        return Model(share=n / max(1, n + m))
    thirds = [[(Counter(), Counter()) for _ in range(3)] for _ in sides]
    for side, own in zip(sides, thirds, strict=True):
        for k, line in enumerate(side):
            for count, found in zip(own[k % 3], fragments(line), strict=True):
                count.update(found)

    def summed(ks: set[int]) -> list[tuple[Counter, Counter]]:
        return [tuple(sum((own[k][way] for k in ks), Counter()) for way in (0, 1)) for own in thirds]

    x, y = [], []
    for k in range(3):
        pair = tuple(map(compressor, dictionaries([[line for j, line in enumerate(side) if j % 3 != k] for side in sides], summed({0, 1, 2} - {k}))))
        for side, mark in zip(sides, (1.0, 0.0), strict=True):
            x += [features(pair, line) for line in side[k::3]]
            y += [mark] * len(side[k::3])
    model = Model(*dictionaries(sides, summed({0, 1, 2})))
    x, y = np.array(x, float), np.array(y)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps, weights held by a unit prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    w[-1] += math.log((odds or n / m) / (len(sides[0]) / len(sides[1])))
    model.weights = w
    return model


def sample_line(text: str | None) -> bytes:
    """The text's normal line; of one longer than SAMPLE_BYTES pieces spread over the whole."""
    line = normal(text)
    if len(line) <= SAMPLE_BYTES:
        return line
    step = len(line) / (SAMPLE_BYTES // PIECE)
    return b" " + b" ".join(line[int(k * step):int(k * step) + PIECE].partition(b" ")[2].rpartition(b" ")[0] for k in range(SAMPLE_BYTES // PIECE)) + b" "


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    marked = labels.select(F.col("doc_id").alias("of"), "toxic").where("of is not null and toxic in (0, 1)").where(fold(F.col("doc_id"), 5) != 0)
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for kind, n in sizes.items():
        bound = int((1 << 20) * min(1.0, train_rows / n))
        keep |= (F.col("toxic") == kind) & (F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < bound)
    drawn = F.broadcast(marked.where(keep))
    rows = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("of")).where("text <> ''").select("of", "toxic", "text")
    rows = map_rows(rows, "of long,toxic int,line binary", lambda: lambda of, mark, text: (of, mark, sample_line(text))).collect()
    rows = sorted(((r.of, r.toxic, bytes(r.line)) for r in rows), key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[2]))
    odds = sizes[1] / sizes[0] if sizes.get(0) and sizes.get(1) else None
    return train([x for _, t, x in rows if t == 1], [x for _, t, x in rows if t == 0], odds)


SCHEMA = "doc_id long,score double,predicted int"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    def make():
        score = model.scorer()

        def one(doc_id: int | None, text: str | None) -> tuple:
            s = score(text)
            return doc_id, s, int(s >= 0.5)
        return one

    return map_rows(docs.select("doc_id", "text"), SCHEMA, make)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")

"""Quality by votes of the nearest labelled neighbours.

A document's terms are trigrams of character classes (a letter by its case, a digit, a
blank, a line end, and each other ASCII character as itself), whether a word or a line
stood before in the same text, and its length on a log scale. So they are the same in
every language. Counts become square roots of shares; the terms that most documents of a
bounded labelled sample have are kept, centred on the sample's mean and reduced to latent
dimensions by the sample's singular vectors. The sample's vectors and labels are broadcast;
every document is compared with all of them by exact cosine, a block of documents at a
time, and the `VOTERS` nearest vote with their similarity as weight. A vote also counts
by how many labelled rows of its class it stands for, as the sample takes as many of a
rare class as of a common one.

Bounded: the sample has about `TRAIN_ROWS` rows of each class at most (drawn by hash of
the id) and sends at most `TERMS_A_ROW` counts a row to the driver, never a text.

Defined results: null, empty and blank texts have the length term alone and are compared
like any other; a vector of length zero, and any text without labelled rows, gets the share
of label 1 (0 without labels). Rows of the same id are scored each by its own text; sample
rows with equal vectors all vote; of neighbours at equal similarity the first in the order
(hash of id, counts) count. Labels other than 0 and 1, and labels without an id, are left
out. Only doc_id, text and the named labels are read, so other columns may have any name.
An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import arrow_schema, fold, map_rows, slices

#: Labelled rows of each class that are broadcast, at most (expected; drawn by hash of the id).
TRAIN_ROWS = 2_000
#: Kept terms, latent dimensions, neighbours that vote, rows of a block.
TERMS, LATENT, VOTERS, BLOCK = 2_048, 48, 25, 512
#: Counts a sample row sends to the driver at most: its most frequent terms.
TERMS_A_ROW = 4_096
#: Bytes of a text that are counted at a time.
STRIDE = 1 << 20

LOWER, UPPER, DIGIT, BLANK, LINE, OTHER = range(6)
SIDE = 40  # classes, rounded up; a trigram fits 16 bits
EXTRA = SIDE ** 3  # terms after the trigrams: word again, word new, line again, line new, then lengths
LENGTHS = 24
ALL = EXTRA + 4 + LENGTHS


def class_table() -> np.ndarray:
    """Byte -> class; the continuation bytes of a code point are left out before."""
    table = np.full(256, OTHER, np.uint8)
    table[0xC0:] = LOWER  # first byte of a letter beyond ASCII, mostly
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = LOWER, UPPER, DIGIT
    table[[0x20, 0x09]], table[[0x0A, 0x0B, 0x0C, 0x0D]] = BLANK, LINE
    marks = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    table[marks] = np.arange(OTHER + 1, OTHER + 1 + len(marks))
    return table


CLASSES, CONTINUATION = class_table().tobytes(), bytes(range(0x80, 0xC0))


def trigrams(raw: bytes, before: bytes = b"") -> np.ndarray:
    """The class trigrams of the bytes, two classes `before` them included."""
    kinds = np.frombuffer(before + raw.translate(CLASSES, CONTINUATION), np.uint8).astype(np.uint16)
    return (kinds[:-2] * np.uint16(SIDE) + kinds[1:-1]) * np.uint16(SIDE) + kinds[2:]


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(term, square root of its share) of one whole text, terms ascending. Shares are of
    the trigrams, of the words and of the lines; the length is one term of weight 1/2."""
    raw = (text or "").encode()
    if len(raw) <= STRIDE:
        codes = np.sort(trigrams(raw), kind="stable")  # by radix
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        term, count = codes[first].astype(np.int64), np.diff(first, append=len(codes))
    else:
        total = np.zeros(EXTRA, np.int64)
        for at in range(0, len(raw), STRIDE):
            # the two classes before a piece are among the last eight bytes, which no code point outgrows
            before = raw[max(0, at - 8):at].translate(CLASSES, CONTINUATION)[-2:]
            total += np.bincount(trigrams(raw[at:at + STRIDE], before), minlength=EXTRA)
        term = np.flatnonzero(total)
        count = total[term]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    term, share = [term], [count / max(1, count.sum())]
    for k, units in ((0, words), (2, lines)):
        if units:
            new = len(set(units)) / len(units)
            term.append(np.array([EXTRA + k, EXTRA + k + 1]))
            share.append(np.array([1 - new, new]))
    term.append(np.array([EXTRA + 4 + min(LENGTHS - 1, len(words).bit_length())]))
    share.append(np.array([0.25]))
    return np.concatenate(term), np.sqrt(np.concatenate(share))


def nearest(near: np.ndarray, voters: int) -> np.ndarray:
    """The columns of the `voters` largest values of each row; of equal ones the first columns."""
    if near.shape[1] <= voters:
        return np.broadcast_to(np.arange(near.shape[1]), near.shape)
    least = np.partition(near, -voters, axis=1)[:, -voters]
    row, col = np.nonzero(near >= least[:, None])
    size = np.bincount(row, minlength=len(near))
    if (size > voters).any():  # ties at the last place: those above it first, then in order
        order = np.lexsort((col, -near[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        row, col = row[place < voters], col[place < voters]
    return col.reshape(len(near), voters)


@dataclass
class Model:
    """Kept terms (ascending), the sample's mean, the projection and the voters."""
    kept: np.ndarray | None = None
    mean: np.ndarray | None = None
    project: np.ndarray | None = None
    vectors: np.ndarray | None = None  # unit rows
    labels: np.ndarray | None = None
    weights: np.ndarray | None = None
    share: float = 0.0

    def rows(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The kept terms of the documents, one row each."""
        out = np.zeros((len(documents), len(self.kept)), np.float32)
        for row, (term, value) in enumerate(documents):
            at = np.searchsorted(self.kept, term)
            at[at == len(self.kept)] = 0
            own = self.kept[at] == term
            out[row, at[own]] = value[own]
        return out

    def latent(self, rows: np.ndarray) -> np.ndarray:
        """Unit latent vectors; zero where a row has none."""
        out = (rows - self.mean) @ self.project
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]], voters: int = VOTERS) -> np.ndarray:
        """Votes of the nearest labelled vectors, for a block of documents."""
        if self.vectors is None or not len(documents):
            return np.full(len(documents), self.share)
        own = self.latent(self.rows(documents))
        near = np.round(own.astype(float) @ self.vectors.T.astype(float), 6)  # so that a block's shape does not matter
        order = nearest(near, voters)
        vote = np.maximum(np.take_along_axis(near, order, 1), 0).astype(float) * self.weights[order]
        total = vote.sum(1)
        score = np.divide((vote * self.labels[order]).sum(1), total, out=np.full(len(own), self.share), where=total > 0)
        return np.clip(np.where(own.any(1), score, self.share), 0.0, 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], sizes: dict[int, int]) -> Model:
    """From the sample's terms and labels in a fixed order; `sizes` are the labelled rows
    of each class that the sample was drawn from."""
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not rows:
        return Model(share=share)
    seen = np.bincount(np.concatenate([t for t, _ in rows]), minlength=ALL)
    most = np.lexsort((np.arange(ALL), -seen))[:TERMS]
    model = Model(kept=np.sort(most[seen[most] > 0]), share=share)
    x = model.rows(rows)
    model.mean = x.mean(0)
    centred = (x - model.mean).astype(np.float64)
    value, vector = np.linalg.eigh(centred.T @ centred)
    model.project = vector[:, ::-1][:, :LATENT].astype(np.float32)
    model.vectors = model.latent(x)
    model.labels = np.array(labels, float)
    drawn = np.bincount(labels, minlength=2)
    model.weights = np.array([sizes[k] / drawn[k] for k in labels])
    return model


def sample_terms(rows: DataFrame) -> DataFrame:
    """(of, label, term, value) of the rows (of, label, text): the sample's terms, made on the executors."""
    def make() -> Callable[..., tuple]:
        def one(of: int, label: int, text: str | None) -> tuple:
            term, value = terms(text)
            if len(term) > TERMS_A_ROW:
                own = np.sort(np.argsort(-value, kind="stable")[:TERMS_A_ROW])
                term, value = term[own], value[own]
            return of, label, term.astype("<i4").tobytes(), value.astype("<f4").tobytes()
        return one

    return map_rows(rows, "of long,label int,term binary,value binary", make)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the rows of `docs` whose id the table `labels` marks 0 or 1 in column
    `label`, ids of fold 0 of 5 left out."""
    marked = (labels.select(F.col("doc_id").alias("of"), F.col(label).cast("int").alias("label"))
              .where("of is not null and label in (0, 1)").where(fold(F.col("of"), 5) != 0))
    sizes = {r.label: r.n for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for kind, n in sizes.items():
        keep |= (F.col("label") == kind) & (F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_rows / n)))
    drawn = F.broadcast(marked.where(keep))
    rows = sample_terms(docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("of")).select("of", "label", "text")).collect()
    rows = sorted(rows, key=lambda r: (hash_of(r.of), bytes(r.term), bytes(r.value)))
    counts = [(np.frombuffer(r.term, "<i4").astype(np.int64), np.frombuffer(r.value, "<f4")) for r in rows]
    return train(counts, [r.label for r in rows], sizes)


def hash_of(number: int) -> int:
    """A fixed order unrelated to the ids' own (multiplicative hash)."""
    return (number * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


SCHEMA = "doc_id long,score double"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of `docs` (doc_id, text); the model is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, types = held.value, arrow_schema(SCHEMA)
        for batch in batches:
            for part in slices(batch):
                for at in range(0, part.num_rows, BLOCK):
                    ids, texts = part.slice(at, BLOCK).columns
                    score = own.scores([terms(t) for t in texts.to_pylist()])
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(score)], schema=types)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

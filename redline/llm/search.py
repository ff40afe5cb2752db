"""Ranked lexical search by two trees.

A document is a point with one coordinate for each term of the items: the part of its
score that the term's frequency and the document's length give. An item is a point whose
coordinates are the weights of its terms. Each task arranges its documents, chunk by
chunk, in a hierarchy (documents with the same rarest term beside each other) and meets
it with a hierarchy of the items. A node of either tree holds the maximum of every
coordinate over what lies below it, so the product of two nodes bounds every score
between them from above. A pair of nodes whose bound is below the weakest kth score of
the node's items is dropped whole; the others are split, down to single items and
documents, whose scores are summed in 64-bit integers. Bounds are sums of whole numbers
below 2^53, so they are exact in doubles too, and equal scores are kept: nothing that
ranks is lost.

The weakest kth scores start from the best documents of a sixteenth of the corpus (by
hash): scores that exist are lower bounds whatever the sample.

Bounded: items are taken in blocks of at most `BLOCK_ITEMS` items and `BLOCK_TERMS`
distinct terms (one larger item is a block of its own); a block is broadcast, and the
driver receives two numbers a term and one an item of it. Documents move nowhere: only
each task's best `k` rows of an item are shuffled.

Defined results: a null text has no terms, and neither ranks nor counts; every row of the
items is an item of its own, repeated or without id; an item without terms has no rows.
Rows of the same doc_id rank each by its own text; rows without id come last among equal
scores. Only the named columns are read. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redline.llm.common import arrow_schema, cut, slices

#: Items and distinct terms of a block of items that is broadcast.
BLOCK_ITEMS, BLOCK_TERMS = 1_024, 16_384
#: Coordinates (documents x terms) of a chunk of documents that is searched at a time, at most.
CHUNK = 1 << 23
#: Documents of a chunk, children of a node of either tree.
CHUNK_ROWS, FAN = 2_048, 8
#: One document in this many sets the first kth scores.
SEED = 16

KEPT = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in KEPT else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order: runs of ASCII letters, digits and anything beyond ASCII."""
    return (text or "").encode().translate(TERM).split()


@dataclass
class Block:
    """Some items: their ids, the terms of all of them, and the numbers of each one's terms."""
    ids: list[int | None] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    own: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id: int | None, found: list[bytes]) -> None:
        self.ids.append(item_id)
        self.own.append(np.array(sorted(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found), np.int64))


def blocks(items: DataFrame, id_col: str, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """The rows of `items` (id, text) that have a term, block by block, without holding more than one block."""
    block = Block()
    for item_id, text in items.select(F.col(id_col).cast("long"), "text").toLocalIterator():
        found = sorted(set(terms(text)))
        if not found:
            continue
        new = sum(t not in block.vocabulary for t in found)
        if block.ids and (len(block.ids) >= most_items or len(block.vocabulary) + new > most_terms):
            yield block
            block = Block()
        block.add(item_id, found)
    if block.ids:
        yield block


VECTORS = "doc_id long,n long,terms array<int>,tf array<int>"


def vectors(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, terms, tf): n terms in all, and how often each of the block's occurs, of every document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, types = held.value, arrow_schema(VECTORS)
        known = vocabulary.keys()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = terms(text)
                    if found:
                        tf = Counter(found)
                        own = sorted((vocabulary[t], tf[t]) for t in known & tf.keys())
                        rows.append((doc_id, len(found), [t for t, _ in own], [c for _, c in own]))
                cols = zip(*rows, strict=True) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, types, strict=True)], schema=types)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, VECTORS)


def totals(points: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each of `size` terms): summed in each task, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2, np.int64)
        for batch in batches:
            sums[size] += batch.num_rows
            sums[size + 1] += batch.column(0).to_numpy(zero_copy_only=False).sum()
            sums[:size] += np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], schema=arrow_schema("at long,n long"))

    sums = np.zeros(size + 2, np.int64)
    for r in points.select("n", "terms").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    return int(sums[size]), int(sums[size + 1]), sums[:size]


def weights(N: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impact(tf: np.ndarray, n: np.ndarray, N: int, L: int) -> np.ndarray:
    """What a term's frequency gives in a document of n terms, before its weight."""
    m = 100 - 90 + (90 * n * N) // L
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def grouped(matrix: np.ndarray, size: int) -> np.ndarray:
    """The maximum of every `size` rows, column by column."""
    return np.maximum.reduceat(matrix, np.arange(0, len(matrix), size), axis=0)


class Search:
    """The items' tree, the best `k` documents of each item so far, and the search of one chunk."""

    def __init__(self, own: list[np.ndarray], w: np.ndarray, k: int, floors: np.ndarray) -> None:
        self.w, self.k = w, k
        # items with the same rarest terms beside each other
        self.order = sorted(range(len(own)), key=lambda i: sorted(zip(-w[own[i]], own[i].tolist(), strict=True))[:4])
        self.own = [own[i] for i in self.order]
        self.floor = np.maximum(floors[self.order], 1)  # a score has to be above 0
        self.best: list[list[tuple[int, float, int | None]]] = [[] for _ in own]
        self.exact = self.pairs = 0

    def coordinates(self, cols: np.ndarray) -> np.ndarray:
        """(items x cols) weights of the items' terms among the ascending terms `cols`."""
        out = np.zeros((len(self.own), len(cols)))
        for i, own in enumerate(self.own):
            at = np.searchsorted(cols, own)
            at[at == len(cols)] = 0
            hit = cols[at] == own
            out[i, at[hit]] = self.w[own[hit]]
        return out

    def chunk(self, ids: list[int | None], doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Search the documents `ids`; document doc[j] has impact value[j] at term[j]."""
        rarest = np.full(len(ids), -1)
        by_weight = np.lexsort((term, self.w[term], doc))
        rarest[doc[by_weight]] = term[by_weight]  # of each document the last one stays: the weightiest
        place = np.empty(len(ids), np.int64)
        place[np.argsort(rarest, kind="stable")] = np.arange(len(ids))
        cols, col = np.unique(term, return_inverse=True)
        points = np.zeros((len(ids), len(cols)), np.int32)  # an impact is below a million
        points[place[doc], col] = value
        named: list[int | None] = [None] * len(ids)
        for i, p in enumerate(place.tolist()):
            named[p] = ids[i]

        leaves = grouped(points, FAN).astype(float)  # products and sums stay below 2^53, so bounds are exact too
        branches = grouped(leaves, FAN)
        items = self.coordinates(cols)
        groups = grouped(items, FAN)
        weakest = grouped(-self.floor[:, None].astype(float), FAN)[:, 0] * -1
        self.pairs += len(ids) * len(self.own)
        # (branch, top group of items) -> (leaf, group) -> (leaf, item) -> document
        tops = grouped(groups, FAN)
        for top in range(len(tops)):
            inner = np.arange(top * FAN, min(len(groups), (top + 1) * FAN))
            on = np.flatnonzero(branches @ tops[top] >= weakest[inner].min())
            if not len(on):
                continue
            near = (on[:, None] * FAN + np.arange(FAN)).ravel()
            near = near[near < len(leaves)]
            bound = leaves[near] @ groups[inner].T
            for g, column in zip(inner.tolist(), bound.T, strict=True):
                open_leaves = near[column >= weakest[g]]
                if len(open_leaves):
                    self.descend(g, open_leaves, leaves, items, points, cols, named)

    def descend(self, g: int, near: np.ndarray, leaves: np.ndarray, items: np.ndarray, points: np.ndarray, cols: np.ndarray, named: list) -> None:
        """The items of group g against the leaves `near`, then against single documents."""
        inner = np.arange(g * FAN, min(len(items), (g + 1) * FAN))
        bound = leaves[near] @ items[inner].T
        for i, column in zip(inner.tolist(), bound.T, strict=True):
            on = near[column >= self.floor[i]]
            if not len(on):
                continue
            rows = (on[:, None] * FAN + np.arange(FAN)).ravel()
            rows = rows[rows < len(points)]
            at = np.flatnonzero(items[i])
            score = points[np.ix_(rows, at)].astype(np.int64) @ self.w[cols[at]]
            self.exact += len(rows)
            self.take(i, rows, score, named)

    def take(self, i: int, rows: np.ndarray, score: np.ndarray, named: list) -> None:
        good = np.flatnonzero(score >= self.floor[i])
        if not len(good):
            return
        found = self.best[i] + [(-int(s), math.inf if named[r] is None else named[r], named[r]) for r, s in zip(rows[good].tolist(), score[good].tolist(), strict=True)]
        found.sort(key=lambda x: x[:2])
        self.best[i] = found[:self.k]
        if len(found) >= self.k:
            self.floor[i] = max(self.floor[i], -self.best[i][-1][0])


FOUND = "item int,item_id long,doc_id long,score long"


def best(points: DataFrame, block: Block, N: int, L: int, w: np.ndarray, k: int, floors: np.ndarray) -> DataFrame:
    """(item, item_id, doc_id, score): of each task the best `k` documents of each item whose score reaches its floor."""
    held = points.sparkSession.sparkContext.broadcast((block.ids, block.own, w, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, w, floors = held.value
        search, size = Search(own, w, k, floors), max(FAN, min(CHUNK_ROWS, CHUNK // len(w)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                doc_id, n, term, tf = part.columns
                per = np.diff(np.asarray(term.offsets))
                flat = term.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat):
                    lengths = np.repeat(n.to_numpy(zero_copy_only=False), per)
                    value = impact(tf.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths, N, L)
                    search.chunk(doc_id.to_pylist(), np.repeat(np.arange(part.num_rows), per), flat, value)
        rows = [(search.order[i], ids[search.order[i]], doc, -s) for i, found in enumerate(search.best) for s, _, doc in found]
        types = arrow_schema(FOUND)
        cols = zip(*rows, strict=True) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, types, strict=True)], schema=types)

    return points.select("doc_id", "n", "terms", "tf").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame | None:
    points = cut(vectors(docs, block))
    N, L, df = totals(points, len(block.vocabulary))
    if not N:
        return None
    w = weights(N, df)
    points = points.where(F.size("terms") > 0)
    floors = np.zeros(len(block.ids), np.int64)
    seeds = points.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0)
    for r in ranked(best(seeds, block, N, L, w, k, floors), k).where(F.col("rank") == k).select("item", "score").collect():
        floors[r.item] = r.score
    return ranked(best(points, block, N, L, w, k, floors), k)


def search(docs: DataFrame, items: DataFrame, id_col: str = "item_id", k: int = 10, **bounds: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of `docs` (doc_id, text) for every row of `items` (id, text)."""
    spark: SparkSession = docs.sparkSession
    parts = [p for b in blocks(items, id_col, **bounds) if (p := search_block(docs, b, k)) is not None]
    out = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], FOUND + ",rank int")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), sized AS (
  SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n_terms FROM texts WHERE len(ts) > 0
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n_terms) AS BIGINT) AS total FROM sized
), post AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM texts) GROUP BY r, t
), items AS (
  SELECT row_number() OVER () AS i, item_id,
         unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM benchmark
), weighed AS (
  SELECT t, CAST(floor(1000 * ln((2 * (SELECT docs FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM post GROUP BY t
), scored AS (
  SELECT i.i, i.item_id, p.r, CAST(sum(g.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * s.n_terms * a.docs) // a.total)))) AS BIGINT) AS score
  FROM items i JOIN post p ON i.t = p.t JOIN weighed g ON g.t = p.t JOIN sized s ON s.r = p.r CROSS JOIN whole a
  GROUP BY i.i, i.item_id, p.r
), ranks AS (
  SELECT i.item_id, CAST(row_number() OVER (PARTITION BY i.i ORDER BY i.score DESC, s.doc_id ASC NULLS LAST) AS INTEGER) AS rank, s.doc_id, i.score
  FROM scored i JOIN sized s ON i.r = s.r WHERE i.score > 0
)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
"""

"""Corpus quality checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions.hof import let
from redline.functions.text import normalize_ws
from redline.session import written


def text_key(col) -> Column:
    """Exact-duplicate key: SHA-256 of the lower-cased, blank-normalised text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sha2(normalize_ws(F.lower(c)), 256)


def duplicate_groups(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """X-01 audit: (text_hash, n_copies, first_<id>) per normalised text.
    A hot group is cheap: the aggregation is partial before the shuffle."""
    return df.groupBy(text_key(text_col).alias("text_hash")).agg(
        F.count(F.lit(1)).alias("n_copies"), F.min(id_col).alias(f"first_{id_col}"))


def dedup_exact(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """X-01 dedup: keep the row with the smallest id of each group. The keep
    list is joined back on (hash, id), a unique key, so a group holding a
    third of the rows does not land in one task."""
    keyed = df.withColumn("_k", text_key(text_col))
    first = keyed.groupBy("_k").agg(F.min(id_col).alias(id_col))
    return keyed.join(first, ["_k", id_col], "left_semi").drop("_k")


def ngrams_of(tok, n: int) -> Column:
    """All n-grams of one order (blank-joined), empty when too short."""
    def build(t: Column) -> Column:
        return F.when(F.size(t) >= n, F.transform(
            F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))) \
            .otherwise(F.array().cast("array<string>"))
    return let(F.col(tok) if isinstance(tok, str) else tok, build)


#: Bits that a token's hash is turned by for each place further right in its n-gram; odd, so that 64 places differ.
_TURN = 11


def _turned(x: Column, places: int) -> Column:
    by = places * _TURN % 64
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def ngram_hashes(tok, n: int) -> Column:
    """A 64-bit hash of each n-gram, by position; empty when too short.

    A cyclic polynomial: the tokens' hashes, turned by their place, added without carry. That
    of a window is put together from those of its halves, which neighbouring windows share, so
    each token is hashed once and a position costs about log2(n) steps, not n."""
    def shifted(g: Column, by: int) -> Column:
        return F.slice(g, by + 1, F.greatest(F.size(g) - by, F.lit(0)))

    def join(left: Column, right: Column, by: int) -> Column:
        # the right windows start `by` places further; the last `by` left ones have none
        return let(shifted(right, by), lambda r: F.zip_with(F.slice(left, 1, F.size(r)), r, lambda x, y: x.bitwiseXOR(_turned(y, by))))

    def windows(h: Column, k: int) -> Column:
        if k == 1:
            return h
        if k % 2:
            return let(windows(h, k - 1), lambda g: join(g, h, k - 1))
        return let(windows(h, k // 2), lambda g: join(g, g, k // 2))

    t = F.col(tok) if isinstance(tok, str) else tok
    none = F.array().cast("array<long>")
    return F.when(F.size(t) >= n, let(F.transform(t, lambda x: F.xxhash64(x)), lambda h: windows(h, n))).otherwise(none)


#: Bits of the bitmap of item hashes, as a power of two: its size, whatever the number of items.
BITS = 24


def hash_bitmap(hashes: DataFrame, col: str, bits: int = BITS) -> np.ndarray:
    """Which values the top `bits` bits of a column of hashes take. Spark makes the parts, of
    2^15 bits each; the driver holds 2^bits bits."""
    at = F.shiftrightunsigned(col, 64 - bits)
    parts = hashes.groupBy(F.shiftright(at, 15).alias("at")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("b"))
    out = np.zeros((max(1, 1 << (bits - 15)), 1 << 12), np.uint8)
    for k, b in parts.toLocalIterator():
        out[k] = np.frombuffer(b, np.uint8)
    return out.ravel()


def _may_be_held(hashed: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """(_of, _at, h): the hashes of `hashed` (_of, _hs) whose bit is set, with their places."""
    held = hashed.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, hashes = batch.columns
            flat = hashes.flatten().to_numpy(zero_copy_only=False)
            top = flat.view(np.uint64) >> np.uint64(64 - bits)
            on = np.flatnonzero(held.value[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8) & 1)
            sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, on, side="right")
            yield pa.RecordBatch.from_arrays([of.take(pa.array(row)), pa.array((on - (ends - sizes)[row]).astype(np.int32)), pa.array(flat[on])], names=["_of", "_at", "h"])

    return hashed.mapInArrow(run, T.StructType([hashed.schema["_of"], T.StructField("_at", T.IntegerType()), T.StructField("h", T.LongType())]))


def overlap_candidates(items: DataFrame, item_tok: str, docs: DataFrame, doc_key: str, doc_tok: str, n: int, bits: int = BITS) -> DataFrame:
    """(_of, _at, h): the places of documents whose n-gram has the hash of an item's. Only
    places whose bit is set in the items' bitmap leave their document; the join then decides."""
    keys = written(items.select(F.explode(ngram_hashes(item_tok, n)).alias("h")).distinct())
    hashed = docs.select(F.col(doc_key).alias("_of"), ngram_hashes(doc_tok, n).alias("_hs"))
    return _may_be_held(hashed, hash_bitmap(keys, "h", bits), bits).join(keys, "h", "left_semi")


def ngram_overlap(items: DataFrame, item_key: str, item_tok: str, docs: DataFrame, doc_key: str, doc_tok: str,
                  n: int = 8, bits: int = BITS) -> DataFrame:
    """X-02: per item, its number of n-grams and how many occur in `docs`.

    Document grams are found by a rolling 64-bit hash and a bitmap of the items' hashes, whose
    size `bits` sets; what hits is joined by its hash, then read from its document and compared
    as text. What moves is the hits, however many the items."""
    ig = items.select(item_key, F.explode(ngrams_of(item_tok, n)).alias("g"))
    hits = overlap_candidates(items, item_tok, docs, doc_key, doc_tok, n, bits).groupBy("_of").agg(F.collect_set("_at").alias("_at"))
    met = docs.join(hits, F.col(doc_key) == F.col("_of")).select(F.col(doc_tok).alias("_t"), "_at")
    texts = met.select(F.explode(F.transform("_at", lambda i: F.array_join(F.slice("_t", i + 1, n), " "))).alias("g"))
    matched = texts.distinct().withColumn("_hit", F.lit(1))
    per_item = ig.join(matched, "g", "left").groupBy(item_key).agg(
        F.count(F.lit(1)).alias("n_grams"), F.count("_hit").alias("n_overlap"))
    return items.select(item_key).join(per_item, item_key, "left").select(
        item_key, F.coalesce("n_grams", F.lit(0)).alias("n_grams"),
        F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))

"""Corpus-preparation operators.

Chunking, encoding, batching and label shifting are in-row array work on
each document or line (no shuffle); padding to the longest in a batch is a
window over a bounded batch key; vocabulary ids come from range partitions and
are looked up where the rows are, as far as a bounded table holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions import patterns as pt
from redline.session import written
from redline.functions.hof import let


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def chunk_tokens(df: DataFrame, col: str, max_length: int = pt.CHUNK_MAX_LENGTH,
                 stride: int = pt.CHUNK_STRIDE, min_tokens: int = pt.CHUNK_MIN_TOKENS,
                 drop_contained: bool = False) -> DataFrame:
    """C-10: windows of `max_length` tokens starting every `stride` tokens
    (the start range covers the whole document, so trailing windows that lie
    inside the previous one are kept unless `drop_contained`); windows shorter
    than `min_tokens` are dropped. Output: other columns + chunk_no, tokens."""
    elem = df.schema[col].dataType.elementType.simpleString()

    def windows(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
        return F.when(n == 0, F.array().cast(f"array<struct<chunk_no:int,tokens:array<{elem}>>>")).otherwise(
            F.transform(starts, lambda i: F.struct((i / F.lit(stride)).cast("int").alias("chunk_no"),
                                                   F.slice(w, i + 1, max_length).alias("tokens"))))

    keep = [c for c in df.columns if c != col]
    out = df.select(*keep, F.explode(let(F.col(col), windows)).alias("_w")) \
        .select(*keep, "_w.chunk_no", "_w.tokens").where(F.size("tokens") >= min_tokens)
    if drop_contained:
        out = out.where((F.col("chunk_no") == 0) | (F.size("tokens") > max_length - stride))
    return out


def causal_pairs(df: DataFrame, col: str) -> DataFrame:
    """C-13: inputs = ids[:-1], labels = ids[1:]."""
    n = F.size(col)
    return df.withColumn("inputs", F.slice(col, 1, F.greatest(n - 1, F.lit(0)))) \
             .withColumn("labels", F.slice(col, 2, F.greatest(n - 1, F.lit(0))))


def encode_fixed(df: DataFrame, col: str, length: int = 512, pad=pt.PAD_TOKEN_ID) -> DataFrame:
    """C-11: truncate / right-pad to `length` with an attention mask and a
    `was_truncated` flag (a long prompt can lose its answer marker)."""
    n = F.size(col)
    fill = F.greatest(F.lit(length) - n, F.lit(0))
    return df.select("*",
                     F.concat(F.slice(col, 1, length), F.array_repeat(F.lit(pad), fill)).alias("input_ids"),
                     F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(length))),
                              F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
                     (n > length).alias("was_truncated"))


def batch_id(row_key, size: int) -> Column:
    """C-14: batches of `size` consecutive keys."""
    return F.floor(_c(row_key) / F.lit(size)).cast("long")


def pad_batch(df: DataFrame, col: str, batch_cols, side: str = "left", pad=pt.PAD_TOKEN_ID,
              label_pad=None) -> DataFrame:
    """C-12: pad every row to the longest row of its batch; left padding for
    inference, right padding (optionally with -100 labels) for training.
    The window key is the batch, so groups are bounded by the batch size."""
    w = Window.partitionBy(*batch_cols)
    n = F.size(col)
    df = df.withColumn("batch_len", F.max(n).over(w).cast("int"))
    fill = (F.col("batch_len") - n).cast("int")
    pads = F.array_repeat(F.lit(pad), fill)
    ones, zeros = F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)
    if side == "left":
        df = df.withColumn("padded", F.concat(pads, F.col(col))).withColumn("mask", F.concat(zeros, ones))
    elif side == "right":
        df = df.withColumn("padded", F.concat(F.col(col), pads)).withColumn("mask", F.concat(ones, zeros))
        if label_pad is not None:
            df = df.withColumn("labels", F.concat(F.col(col), F.array_repeat(F.lit(label_pad), fill)))
    else:
        raise ValueError("side must be 'left' or 'right'")
    return df.withColumn("pad_count", fill)


def dense_ids(distinct: DataFrame, col: str) -> DataFrame:
    """(col, id) of a table of distinct values, ids dense from 0 in the order of `col`.

    Spark ranges the values over its partitions and sorts each; a value's id is its place in
    its partition plus the sizes of the partitions before. Those sizes, one a partition, are
    summed on the driver and broadcast; no window, and no task beyond its own range. The
    placed table is written to the shared folder, so that a lost task can't range it anew."""
    placed = written(distinct.repartitionByRange(col).sortWithinPartitions(col).select(col, F.monotonically_increasing_id().alias("place")))
    part, sizes = F.shiftrightunsigned("place", 33), {}
    for p, n in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[p] = n
    before, first = 0, []
    for p in sorted(sizes):
        first.append((p, before))
        before += sizes[p]
    offsets = distinct.sparkSession.createDataFrame(first, "part long, first long")
    at = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("part")).select(col, (F.col("first") + at).alias("id"))


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    """J-09 build side: distinct tokens with dense ids in token order. The table is
    written to the shared folder, so that its size is known."""
    distinct = df.select(F.explode(col).alias("token")).where(F.col("token").isNotNull()).distinct()
    return written(dense_ids(distinct, "token"))


#: Tokens that are looked up where the rows are, without a shuffle: so many at most, none longer than this many bytes.
MAP_TOKENS, MAP_BYTES = 1 << 17, 256


_IDS = T.ArrayType(T.LongType())


def _as_lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """`values` in lists as long as those of `like`."""
    sizes = pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _look_up(table: DataFrame, missing: int | None):
    """array<string> -> array<long> by a broadcast table (token, id); tokens that it lacks give `missing`, NULL tokens NULL."""
    rows = table.select("token", "id").toArrow()
    held = table.sparkSession.sparkContext.broadcast((rows.column("token").combine_chunks(), rows.column("id").combine_chunks()))

    @F.arrow_udf(_IDS)
    def ids(tokens: pa.Array) -> pa.Array:
        known, numbers = held.value
        flat = tokens.flatten()
        at = pc.index_in(flat, value_set=known)
        found = numbers.take(at)
        if missing is not None:
            found = pc.if_else(pc.or_(pc.is_valid(at), pc.is_null(flat)), found, pa.scalar(missing, pa.int64()))
        return _as_lists(tokens, found)

    # else Spark moves a filter on the ids down to the scan, and there makes tokens and ids once more
    return ids.asNondeterministic()


#: Stands for an id that is still to be joined.
_OPEN = -1


@F.arrow_udf(_IDS)
def _fill(ids: pa.Array, joined: pa.Array) -> pa.Array:
    """The open places of each row's ids, in order, from the joined ids."""
    flat, late = ids.flatten(), joined.flatten()
    open_ = pc.fill_null(pc.equal(flat, _OPEN), False)
    return _as_lists(ids, pc.replace_with_mask(flat, open_, late))


def encode_with_vocab(df: DataFrame, col: str, vocab: DataFrame, key_cols, map_tokens: int = MAP_TOKENS, carry=()) -> DataFrame:
    """J-09 probe side: (key_cols, carry, ids) with the id of every token of `col` in order, NULL for
    tokens that the vocabulary lacks; key_cols name a row, rows without tokens are left out.

    A vocabulary of at most `map_tokens` tokens is broadcast and looked up in the row: nothing
    is shuffled. Of a larger one the `map_tokens` commonest tokens of the rows, in the
    vocabulary or not, are looked up so; the others, none of which can be a large group, meet
    it in a join and come back to their rows as one array each."""
    rows = df.select(*key_cols, *carry, F.col(col).alias("_tokens"))
    some = F.size("ids") > 0  # asked of the ids: asked of the tokens they would be made twice
    short = F.octet_length("token") <= MAP_BYTES
    if vocab.count() <= map_tokens and not vocab.where(~short).limit(1).count():
        return rows.select(*key_cols, *carry, _look_up(vocab, None)("_tokens").alias("ids")).where(some)
    counts = rows.select(F.explode("_tokens").alias("token")).where(F.col("token").isNotNull() & short).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    common = written(counts.orderBy(F.col("n").desc(), "token").limit(map_tokens).select("token").join(vocab, "token", "left"))
    first = rows.withColumn("ids", _look_up(common, _OPEN)("_tokens")).where(some)
    late = first.select(*key_cols, F.posexplode(F.arrays_zip("ids", "_tokens")).alias("pos", "t")).where(F.col("t.ids") == _OPEN)
    late = late.select(*key_cols, "pos", F.col("t._tokens").alias("token")).join(vocab, "token", "left")
    late = late.groupBy(*key_cols).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("late"))
    none = F.array().cast("array<bigint>")
    return first.join(late, list(key_cols), "left").select(*key_cols, *carry, _fill("ids", F.coalesce("late", none)).alias("ids"))

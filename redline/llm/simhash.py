"""SimHash near-duplicates by anchor-point covering.

The 64 fingerprint bits are nine blocks of seven and one bit. Hamming's [7,4] code
covers a block with radius 1, so the product code (2^37 words) covers every
fingerprint; its words are the anchors. Two fingerprints within t bits have a
midpoint within ceil(t/2) of both, and the midpoint's anchor lies, block by block,
within the covering radius plus ceil(t/2) of both. Each fingerprint is therefore
replicated to every such anchor (about 26 for t = 2) and compared with the others
of that anchor only. No pair is lost, and an anchor holds fewer than one
fingerprint per hundred billion on average.

Only distinct fingerprints are replicated, so copies cost one row each.

Defined results: null and empty texts have fingerprint zero and link like any
other; a component without any id has a null component_id; rows of the same id are
rows of their own. Only doc_id and text are read, so other columns may have any name; the
stage keeps them. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.common import cut, map_rows
from redline.llm.components import components


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones, block = np.zeros(64, np.int64), 1 << 15
    for at in range(0, n, block):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:min(at + block, n)].tolist(), ends[at:at + block].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def hamming_words() -> np.ndarray:
    """The 16 words of the [7,4] code: those whose set positions (1 to 7) cancel under xor."""
    def syndrome(v: int) -> int:
        out = 0
        for k in range(7):
            out ^= (k + 1) * (v >> k & 1)
        return out
    return np.array([v for v in range(128) if syndrome(v) == 0], np.int64)


def anchors(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius plus ceil(bits / 2) of each fingerprint."""
    words, value = hamming_words(), np.arange(128)
    away = np.bitwise_count(value[:, None] ^ words[None, :]).astype(np.int64)
    reach = np.maximum(away - 1, 0)  # flips until a block decodes to the word
    free = np.array([[0, 1], [1, 0]])  # the single bit is its own anchor
    row, left = np.arange(len(prints)), np.full(len(prints), (bits + 1) // 2)
    acc = np.zeros(len(prints), np.int64)
    for k in range(10):
        table = reach if k < 9 else free
        block = (prints[row] >> (7 * k)) & (127 if k < 9 else 1)
        cost = table[block]
        at, word = np.nonzero(cost <= left[:, None])
        row, left, acc = row[at], left[at] - cost[at, word], acc[at] << 4 | word
    return row, acc


def replicate(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, anchor) of each row of `prints` (fp)."""
    types = pa.schema([("fp", pa.int64()), ("anchor", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                own = fps[at:at + 4096]
                row, anchor = anchors(own, bits)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(anchor)], schema=types)

    return prints.select("fp").mapInArrow(run, "fp long, anchor long")


def links(prints: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at `bits` or fewer differing bits. The
    anchors are sorted and merged: Spark takes them for no larger than the fingerprints'
    file, a few bytes a row of which there are many times more, and would broadcast them."""
    near = replicate(prints, bits)
    a, b = near.select(F.col("fp").alias("a"), "anchor"), near.select(F.col("fp").alias("b"), F.col("anchor").alias("at"))
    close = (F.col("anchor") == F.col("at")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return a.join(b.hint("merge"), close).select("a", "b").distinct()


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def members(docs: DataFrame, row: Column, shingle: int = 3, bits: int = 2) -> DataFrame:
    """(row, doc_id, fp, first) of every row of `docs` (doc_id, text), `row` being its
    number; first (doc_id, row) is the smallest of the component, null without any id."""
    numbered = docs.select(row.alias("row"), "doc_id", "text")
    prints = cut(map_rows(numbered, "row long,doc_id long,fp long", lambda: lambda row, doc_id, text: (row, doc_id, fingerprint(text, shingle))))
    named_row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))
    each = cut(prints.groupBy("fp").agg(F.min(named_row).alias("least")))
    roots = components(links(each, bits))
    linked = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "r"))
    named = cut(linked.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("of"), "first"))
    return prints.join(named, F.col("fp") == F.col("of")).drop("of")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text)."""
    every = members(docs, F.lit(0).cast("long"), shingle, bits)
    return every.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


#: Name of the written row number, unlike any column of the caller's.
ROW = "_row_of_simhash_keep"


def keep(docs: DataFrame) -> DataFrame:
    """Stage: one row of each component of `docs`, of its smallest id, all columns. Rows
    without an id stay only where no row of their component has one, and then all do:
    nothing tells which comes first."""
    numbered = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    kept = members(numbered, F.col(ROW)).where(F.col("first").isNull() | (F.col("first.row") == F.col("row"))).select(F.col("row").alias("kept"))
    return numbered.alias("d").join(kept.alias("k"), F.col(f"d.{ROW}") == F.col("k.kept"), "left_semi").drop(ROW)

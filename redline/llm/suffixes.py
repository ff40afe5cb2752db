"""Repeated passages by a logarithmic family of suffix arrays.

A byte goes if some string of LENGTH bytes that covers it starts anywhere else too.
Every window of LENGTH bytes has one anchor: the position in it whose GRAM bytes hash
lowest, the leftmost of equals. The anchor depends on the window's bytes alone, so
equal windows have equal grams at equal offsets. A run of windows with the same
anchor is one row (gram, hash of the run's bytes, place): about one row in 85 bytes.

1. Rows are counted per gram. A gram met once settles its windows: none repeats.
2. A gram whose rows are all equal settles them too: all windows repeat.
3. Of every other gram, one row per distinct run goes with its bytes to the gram's
   partition. There each batch of rows gets a suffix array (the starts of its windows,
   ordered by a fingerprint of the LENGTH bytes that follow), is merge-scanned against
   the levels there are for equal windows, and becomes a level itself; levels of equal
   size merge, so a family of n rows holds log n levels. Rows come sorted by gram, and a
   family that holds FAMILY windows ends where the next gram starts: what a task holds is
   bounded by FAMILY and one gram's rows, not by its partition.
   A gram of more than HOT distinct runs would fill one partition; its windows are
   counted by their fingerprints instead, which Spark adds up before it moves them.
4. The repeated windows of each document, as byte ranges, meet the document again.

Texts move once (both joins use the same exchange). Equal hashes are taken as equal
bytes: runs by two 64-bit hashes, windows by one within a gram's partition.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows
with the same id and text are documents of their own, so such copies are removed. Of equal
hashes in a window the leftmost anchors it. Only doc_id and text are read, so other columns
may have any name. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import arrow_schema, cut, slices

LENGTH, GRAM = 200, 32
#: Windows of a text are taken in pieces of so many; 21 bits hold a place in a piece.
PIECE = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
#: Distinct runs of one gram that one partition takes; more are counted by window.
HOT = 4096
#: Windows that a family takes before the next gram starts a new one.
FAMILY = 1 << 20


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit value per byte, and the powers of an odd number and of its inverse."""
    rng = np.random.default_rng(200)
    value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x2545F4914F6CDD1D
    size = PIECE + LENGTH + 1

    def powers(b: int) -> np.ndarray:
        out = np.full(size, b, np.uint64)
        out[0] = 1
        return np.cumprod(out)
    return value, powers(base), powers(pow(base, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    value, power, _ = tables()
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[:len(data)], out=out[1:])
    return out


def window_prints(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A fingerprint of the `length` bytes from each place on."""
    sums, inverse = prefix(data), tables()[2]
    n = len(data) - length + 1
    return mix((sums[length:] - sums[:n]) * inverse[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from minima towards both ends of blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def runs(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, windows, gram hash, run hash) of each run of windows with one anchor."""
    sums, inverse = prefix(data), tables()[2]
    n = len(data) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:n]) * inverse[:n])
    least = sliding_least((grams & ~PLACE) | np.arange(n, dtype=np.uint64), LENGTH - GRAM + 1)
    anchor = (least & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    windows = np.diff(np.append(first, len(anchor)))
    at = anchor[first]
    bytes_hash = (sums[first + windows - 1 + LENGTH] - sums[first]) * inverse[first]
    shape = (windows.astype(np.uint64) << np.uint64(32)) | (at - first).astype(np.uint64)
    return first, windows, grams[at].view(np.int64), mix(bytes_hash ^ mix(shape)).view(np.int64)


def pieces(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        yield at, data[at:at + PIECE + LENGTH - 1]


def binary(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def joined(lo: np.ndarray, windows: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of windows, in order, joined where one starts within or right after those before."""
    start, end = lo[on], (lo + windows)[on]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    first = start[new]
    return first, reach[np.append(new[1:], True)] - first


ROWS = "k long,lo long,windows int,gram long,run long,times int"


def anchored(texts: DataFrame) -> DataFrame:
    """ROWS of texts (k, text): each distinct run of a document once, with its number
    there; windows of runs that a document holds several times also as rows without
    gram, neighbours joined, which are repeated whatever other documents hold."""
    types = arrow_schema(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list[np.ndarray]] = [[] for _ in types]
                none = []
                for k, raw in zip(part.column(0).to_pylist(), binary(part.column(1)), strict=True):
                    found = [(at + f, w, g, r) for at, piece in pieces(raw) for f, w, g, r in [runs(piece)]]
                    if not found:
                        continue
                    lo, windows, gram, own = (np.concatenate(c) for c in zip(*found, strict=True))
                    _, once, back, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
                    first, size = joined(lo, windows, times[back] > 1)
                    n, zero = len(once) + len(first), np.zeros(len(first), np.int64)
                    for c, v in zip(out, (np.full(n, k), np.concatenate([lo[once], first]), np.concatenate([windows[once], size]),
                                          np.concatenate([gram[once], zero]), np.concatenate([own[once], zero]), np.concatenate([times, zero])), strict=True):
                        c.append(v)
                    none.append(np.arange(n) >= len(once))
                if none:
                    cols = [np.concatenate(c) for c in out]
                    mask = np.concatenate(none)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.type.to_pandas_dtype()), t.type, mask=mask if t.name == "gram" else None)
                                                      for c, t in zip(cols, types, strict=True)], schema=types)

    return texts.select("k", "text").mapInArrow(run, ROWS)


class Family:
    """Levels of sorted fingerprints, each at least twice the size of the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.repeated: list[np.ndarray] = []
        self.size = 0

    def add(self, prints: np.ndarray) -> None:
        """A batch: its suffix array, its matches in itself and in all levels, and its place among them."""
        mine = np.arange(self.size, self.size + len(prints))
        self.size += len(prints)
        order = np.argsort(prints, kind="stable")
        keys, owner = prints[order], mine[order]
        equal = keys[1:] == keys[:-1]
        self.repeated += [owner[1:][equal], owner[:-1][equal]]
        for level, holder in self.levels:
            if len(level):
                at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
                hit = level[at] == keys
                self.repeated += [owner[hit], holder[at[hit]]]
        one = np.append(True, ~equal) if len(keys) else np.zeros(0, bool)
        self.levels.append((keys[one], owner[one]))  # one of equal windows is enough to find the next
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            keys, owner = np.concatenate([b, a]), np.concatenate([y, x])
            order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
            keys, owner = keys[order], owner[order]
            one = np.append(True, keys[1:] != keys[:-1])
            self.levels.append((keys[one], owner[one]))

    def marks(self) -> np.ndarray:
        out = np.zeros(self.size, bool)
        for m in self.repeated:
            out[m] = True
        return out


def spans(marks: np.ndarray) -> list[int]:
    """Runs of marked windows, as first, last, first, last ..."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    edge[1::2] -= 1
    return edge.tolist()


FOUND = "gram long,run long,ends array<int>"


def matched(bodies: DataFrame, limit: int = FAMILY) -> DataFrame:
    """FOUND of bodies (gram, run, body): which windows of each run another run of its
    gram holds too, from families of suffix arrays over whole grams."""
    types = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, last = Family(), [], None

        def take(part: pa.RecordBatch, sizes: np.ndarray) -> None:
            if len(sizes):
                salt = mix(part.column(0).to_numpy().view(np.uint64))
                family.add(np.concatenate([window_prints(np.frombuffer(b, np.uint8)) ^ g for g, b in zip(salt, part.column(2).to_pylist(), strict=True)]))
                rows.append((part.select([0, 1]), sizes))

        for batch in batches:
            for part in slices(batch, 2 << 20):
                grams = part.column(0).to_numpy()
                sizes = np.array([len(b) - LENGTH + 1 for b in part.column(2).to_pylist()], np.int64)
                total, at = np.append(0, np.cumsum(sizes)), 0
                for start in np.flatnonzero(np.diff(grams, prepend=grams[:1] if last is None else last)).tolist():
                    if family.size + total[start] - total[at] >= limit:
                        take(part.slice(at, start - at), sizes[at:start])
                        yield from told(family, rows, types)
                        family, rows, at = Family(), [], start
                take(part.slice(at), sizes[at:])
                if len(grams):
                    last = grams[-1]
        yield from told(family, rows, types)

    return bodies.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, FOUND)


def told(family: Family, rows: list[tuple[pa.RecordBatch, np.ndarray]], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """FOUND of a family and the rows that it took."""
    marks, at = family.marks(), 0
    for own, sizes in rows:
        ends = []
        for n in sizes.tolist():
            ends.append(spans(marks[at:at + n]))
            at += n
        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(ends, types[2].type)], schema=types)


BODY = "gram long,run long,body binary,prints array<long>"


def bodies_of(joined: DataFrame) -> DataFrame:
    """BODY of (doc_id, k, text, runs): the bytes of each run, of a hot gram's runs the window fingerprints."""
    types = arrow_schema(BODY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for raw, own in zip(binary(part.column(2)), part.column(3).to_pylist(), strict=True):
                    for r in own:
                        body = raw[r["lo"]:r["lo"] + r["windows"] - 1 + LENGTH]
                        prints = window_prints(np.frombuffer(body, np.uint8)).view(np.int64) if r["hot"] else None
                        rows.append((r["gram"], r["run"], None if r["hot"] else body, prints))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return joined.select("doc_id", "k", "text", "runs").mapInArrow(run, BODY)


def counted(hot: DataFrame) -> DataFrame:
    """FOUND of (gram, run, prints) by counting windows: Spark adds up equal ones before they move."""
    each = hot.select("gram", "run", F.posexplode("prints").alias("w", "p")).withColumn("p", F.xxhash64("gram", "p"))
    twice = each.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("p", "q")
    back = each.join(twice, F.col("p") == F.col("q")).groupBy("gram", "run").agg(F.collect_list("w").alias("ws"))
    return back.select("gram", "run", F.flatten(F.transform("ws", lambda w: F.array(w, w))).alias("ends"))


RESULT = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string"


def covered(ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Byte ranges joined where they touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in ranges:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]])


def strip(joined: DataFrame) -> DataFrame:
    """RESULT of (doc_id, text, ranges: flat list of lo, hi)."""
    types = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, raw, flat in zip(part.column(0).to_pylist(), binary(part.column(1)), part.column(2).to_pylist(), strict=True):
                    own = covered([[r["lo"], r["hi"]] for r in flat or []])
                    rows.append((doc_id, len(raw), sum(b - a for a, b in own), len(own), hashlib.sha256(remove(raw, own)).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return joined.select("doc_id", "text", "ranges").mapInArrow(run, RESULT)


def repeated_ranges(texts: DataFrame, hot: int = HOT, family: int = FAMILY) -> DataFrame:
    """(k, lo, hi) of all windows that repeat, as byte ranges, of texts (doc_id, k, text)."""
    rows = anchored(texts)
    per = rows.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("n"), F.min("run").alias("a"), F.max("run").alias("b"))
    grams = cut(per.where("n > 1").select(F.col("gram").alias("g"), (F.col("a") != F.col("b")).alias("mixed")))
    met = cut(rows.join(grams, F.col("gram") == F.col("g"), "left").where("gram is null or g is not null")
              .select("k", "lo", "windows", "gram", "run", "times", F.coalesce("mixed", F.lit(False)).alias("mixed")))
    whole = F.col("lo") + F.col("windows") - 1 + LENGTH
    settled = met.where("not mixed").select("k", "lo", whole.alias("hi"))
    mixed = met.where("mixed")
    # written, and so are the few large grams: joined side by side Spark could not split a gram below an aggregate
    distinct = cut(mixed.groupBy("gram", "run").agg(F.sum("times").alias("n"), F.min(F.struct("k", "lo", "windows")).alias("one")))
    many = cut(distinct.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > hot))
    distinct = distinct.join(many, F.col("gram") == F.col("g"), "left").select("gram", "run", "n", "one.*", F.col("g").isNotNull().alias("hot"))
    wanted = distinct.groupBy(F.col("k").alias("of")).agg(F.collect_list(F.struct("gram", "run", "lo", "windows", "hot")).alias("runs"))
    bodies = bodies_of(texts.join(wanted, F.col("k") == F.col("of")).select("doc_id", "k", "text", "runs"))
    found = matched(bodies.where("body is not null").select("gram", "run", "body"), family)
    if many.limit(1).count():
        found = found.union(counted(bodies.where("prints is not null").select("gram", "run", "prints")))
    ends = found.select(F.col("gram").alias("g"), F.col("run").alias("r"), "ends")
    twice = distinct.where("n > 1").select(F.col("gram").alias("g"), F.col("run").alias("r"), F.lit(None).cast("array<int>").alias("ends"))
    once = ends.join(distinct.where("n = 1").select("gram", "run"), (F.col("g") == F.col("gram")) & (F.col("r") == F.col("run")), "left_semi").where("size(ends) > 0")
    hit = mixed.join(twice.union(once), (F.col("gram") == F.col("g")) & (F.col("run") == F.col("r")))
    pairs = F.when(F.col("ends").isNull(), F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("ends") - 2, F.lit(2)), lambda i: F.struct(F.get("ends", i).alias("a"), F.get("ends", i + 1).alias("b"))))
    part = hit.select("k", "lo", F.explode(pairs).alias("w")).select("k", (F.col("lo") + F.col("w.a")).alias("lo"), (F.col("lo") + F.col("w.b") + LENGTH).alias("hi"))
    return settled.union(part)


def deduplicate(docs: DataFrame, hot: int = HOT, family: int = FAMILY) -> DataFrame:
    """RESULT of every row of docs (doc_id, text)."""
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text")
    ranges = repeated_ranges(texts, hot, family).groupBy(F.col("k").alias("of")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return strip(texts.join(ranges, F.col("k") == F.col("of"), "left"))


def query(docs: DataFrame) -> DataFrame:
    return deduplicate(docs)

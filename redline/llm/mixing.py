"""Mixing sources to target weights, with DataFrame functions only.

Per source the tokens are summed, targets are filled by weight under a cap of
`most` times the source's size, and every document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy whose probability is the fraction left.

The draw u hashes seed, id, source and text. Rows that are equal in all three would
share it and be copied all or none, so m of them take floor(m * fraction + u) extra
copies together, the first ones in the table's order one each; for a single row that
is its Bernoulli draw. They are numbered by the partition they lie in, so that a
large group is never in one task.

Sources are put in order by ranges, and sums over the sources before are sums within a
partition plus those of the partitions before it: no task sees all sources.

Defined results: null text has size 0; a null source is a source of its own, last
in order; null ids, sources and texts draw as empty strings; of sources with equal ratio the
first by code point fills first; other columns may have any name, and the stage keeps
them; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.llm.common import WORD, cut

#: Sources up to which the table of targets (three numbers a source) is broadcast; beyond it Spark joins by source.
BROADCAST_SOURCES = 100_000


def word_total(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target). Targets are in proportion to the weights and sum
    to `share` of all sizes; a target stops at `most` sizes of its source and the excess
    goes to the others by weight, until none is above.

    In the order of cap / weight, the sources that stop come first; for the first one
    that does not, what is left is shared by the weights that are left."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    per = before(per, [F.col("source").asc_nulls_last()], {})
    per = per.select("source", "source_size", F.element_at(cycle, (F.col("rows_before") % len(weights) + 1).cast("int")).cast("long").alias("w"))
    per = before(per, [(F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()], {"source_size": "size_before", "w": "w_before"})
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    per = per.select("source", "source_size", "w", (most * F.col("source_size")).alias("cap"), (F.lit(share * (whole["size"] or 0)) - most * F.col("size_before")).alias("left"),
                     (F.lit(whole["w"] or 0) - F.col("w_before")).alias("w_left"), F.col("rows_before").alias("at"))
    first = per.where(F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left")).agg(F.min(F.struct("at", "left", "w_left")).alias("f")).first().f
    if first is None:
        return per.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    return per.select("source", "source_size", F.when(F.col("at") < first["at"], F.col("cap").cast("double")).otherwise(
        F.lit(first["left"]) * F.col("w") / F.lit(first["w_left"])).alias("target"))


def before(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """`df`, ranged and sorted by `order`, with `rows_before` and for each column of `sums` the
    sum over the rows before. Written to the shared folder in that order; the window over
    partitions has one row of each."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    totals = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"from_{c}") for c in ("n", *[f"all_{c}" for c in sums])])
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.withColumn("part", part).join(F.broadcast(totals), "part")
    out = met.select("*", (F.col("from_n") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rows_before"),
                     *[(F.col(f"from_all_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(name) for c, name in sums.items()])
    return out.select(*df.columns, "rows_before", *sums.values())


#: Name of a row's number, unlike any column of the caller's.
ROW = "_row_of_mixing"


def key(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    """md5 of seed, id, source and text: the same in every run and engine."""
    def part(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    return F.md5(F.concat(F.lit(f"{seed}:"), part(doc_id), F.lit(":"), part(source), F.lit(":"), part(text)).cast("binary"))


def draw(key: Column) -> Column:
    """A number in [0, 1) from the digest."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def repeated(sized: DataFrame) -> DataFrame:
    """(row, m, j) of the rows of `sized` (row, key) that share their key: how many do, and
    the row's place among them from 0. Counts by partition come first, so that no task
    holds a group."""
    part = F.shiftright("row", 33)
    many = cut(sized.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumnRenamed("key", "of"))
    own = cut(sized.select("row", "key", part.alias("part")).join(many, F.col("key") == F.col("of")).drop("of"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.select(F.col("key").alias("k"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("row")) - 1
    met = own.withColumn("place", place).join(counts, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")))
    return cut(met.select("row", "m", (F.col("first") + F.col("place")).alias("j")))


def copies(rate: Column, key: Column) -> Column:
    """floor(rate) copies, and one more for the first floor(m * fraction + u) of m equal rows."""
    extra = F.floor(F.coalesce("m", F.lit(1)) * (rate - F.floor(rate)) + draw(key))
    return F.floor(rate) + (F.coalesce("j", F.lit(0)) < extra).cast("long")


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """`rows` (source) joined with their source's size, target and rate."""
    of = targets.select(F.col("source").alias("of"), F.col("source_size").alias("whole"), F.col("target").alias("aim"))
    of = F.broadcast(of) if targets.count() <= BROADCAST_SOURCES else of
    rate = F.when(F.col("whole") > 0, F.col("aim") / F.col("whole")).otherwise(F.lit(0.0))
    return rows.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).drop("of")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """(row, doc_id, source, size, key) of every row, written: texts are read once."""
    own = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    return cut(own.select("row", "doc_id", "source", word_total(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("source"), F.col("text"), seed).alias("key")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of `docs`
    (doc_id, text, source)."""
    sized = measured(docs, seed)
    targets = cut(source_targets(sized, weights, share, most))
    late = repeated(sized).withColumnRenamed("row", "late")
    out = with_targets(sized, targets).join(late, F.col("row") == F.col("late"), "left")
    return out.select("doc_id", "source", "size", F.col("whole").alias("source_size"), F.col("aim").alias("target"), copies(F.col("rate"), F.col("key")).alias("copies"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The mixed corpus itself: each row of `docs`, all columns, as often as `mix` says. The rate
    depends on the row's source and the draw on the row, so only the targets are joined and no
    text moves; where rows repeat, all are numbered and written first."""
    sized = measured(docs, seed)
    targets = cut(source_targets(sized, weights, share, most))
    if sized.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count():
        docs = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
        named = docs.select(F.col(ROW).alias("row"), key(F.col("doc_id"), F.col("source"), F.col("text"), seed).alias("key"))
        late = repeated(named).withColumnRenamed("row", "late")
    else:
        docs, late = docs.withColumn(ROW, F.lit(0).cast("long")), sized.where("false").select(F.col("row").alias("late"), F.col("row").alias("m"), F.col("row").alias("j"))
    packed = docs.select(F.struct("*").alias("row"), F.col("source"), key(F.col("doc_id"), F.col("source"), F.col("text"), seed).alias("key"))
    met = with_targets(packed, targets).join(late, F.col(f"row.{ROW}") == F.col("late"), "left")
    often = met.select("row", copies(F.col("rate"), F.col("key")).cast("int").alias("copies")).where("copies > 0")
    return often.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*").drop(ROW)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '') || ':' || coalesce(text, '')) AS key FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM sized GROUP BY source
), per AS (
  SELECT source, source_size, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM named
), filled AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER o AS rn,
         1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE
           - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS w_rest
  FROM per WINDOW o AS (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST)
), lead_row AS (
  SELECT rn, rest, w_rest FROM filled WHERE rest * w <= cap * w_rest ORDER BY rn LIMIT 1
), targets AS (
  SELECT f.source, f.source_size, CASE WHEN l.rn IS NULL OR f.rn < l.rn THEN f.cap::DOUBLE ELSE l.rest * f.w / l.w_rest END AS target
  FROM filled f LEFT JOIN lead_row l ON true
), rated AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, k.m, k.j,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         (('0x' || substr(k.key, 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, count(*) OVER (PARTITION BY key) AS m, row_number() OVER (PARTITION BY key) - 1 AS j FROM sized) k
  JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN j < floor(m * (rate - floor(rate)) + u) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

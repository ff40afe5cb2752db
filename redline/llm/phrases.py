"""Phrase collocations from depth-truncated suffix subtrees, group by group.

Vertical partitioning: the frequency of every one-word prefix is counted, then of the
two-word prefixes whose words both reach `least`; no phrase with a rarer word or pair
can be a candidate, so a suffix ends where the next pair is rarer. The two-word prefixes
are put together to groups of at most `BUDGET` suffixes; prefixes that hold more on their
own are extended to the whole truncated suffix and spread over several groups. Every
position sends the suffix that starts there, at most `depth` words and never beyond its
piece, to the group of its prefix, equal ones of a batch of text as one row. Each group
sorts its suffixes and builds its subtree without any other group; a node's count is the
total of the leaves below it. Counts of extended prefixes are summed over their groups.

The prefixes are counted by 64-bit hash: where two share one, only suffixes that no
candidate needs are sent, and the subtrees, which hold the words themselves, don't count
them together. Which words and pairs are frequent reaches the tasks as bitmaps of 2^`BITS`
bits, where a shared bit has the same effect. So results are exact.

Bounded: bitmaps (8 MB each) and a table of 2^`BUCKET_BITS` buckets of prefixes are
broadcast; a task holds the words of about `FLUSH` positions and at most `LEXICON` distinct
words; a group holds `BUDGET` suffixes.

Defined results: a null text has no words; a null lang is `und`, as a lang of that name is;
repeated rows count each; equal scores go by count, then by the bytes of the phrase; texts
of any length are cut into strides at word ends. Only the named columns are read. An empty
table gives an empty result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.llm.common import arrow_schema, cut, slices

DEPTH, LEAST, TOP = 4, 30, 2_000
#: Suffixes of a group.
BUDGET = 1 << 20
#: Bits of a bitmap of frequent prefixes, and of the number of a bucket of prefixes (both as a power of two).
BITS, BUCKET_BITS = 26, 16
#: Positions that are counted together, distinct words kept for them, bytes tokenised at a time.
FLUSH, LEXICON, STRIDE = 1 << 21, 1 << 19, 1 << 22

BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(0x2E if c in BREAKS else 0x20 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, `.` where a piece ends; some megabytes at a time."""
    line, at = raw.translate(TABLE), 0
    while at < len(line):
        end = min(len(line), at + STRIDE)
        if end < len(line):
            last = max(line.rfind(b" ", at, end), line.rfind(b".", at, end))
            if last < at:  # a word of more than a stride: up to its end
                later = [x for x in (line.find(b" ", end), line.find(b".", end)) if x >= 0]
                last = min(later, default=len(line) - 1)
            end = last + 1
        yield line[at:end].replace(b".", b" . ").split()
        at = end


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by piece ends) of batches (lang, text), some megabytes at a time."""
    for batch in batches:
        for part in slices(batch):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text.encode())
            for lang, own in texts.items():
                yield lang, b".".join(own)


def emit(schema: str, *cols) -> pa.RecordBatch:
    types = arrow_schema(schema)
    arrays = [pa.array(c, pa.binary()).cast(pa.string()) if t.type == pa.string() and len(c) and isinstance(c[0], bytes) else pa.array(c, t.type)
              for c, t in zip(cols, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=types)


WORDS = "lang string,word string,n long"


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every word of `docs` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(b".", None)
                yield emit(WORDS, [lang] * len(own), list(own), list(own.values()))
            counts.clear()

        for lang, raw in by_lang(batches):
            for words in tokens(raw):
                counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > LEXICON:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, WORDS).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The top `BITS` bits of the column `h` as a bitmap; Spark makes its parts of 2^15 bits."""
    bit = F.shiftrightunsigned("h", 64 - BITS)
    parts = hashes.groupBy(F.shiftright(bit, 15).alias("at")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((max(1, 1 << (BITS - 15)), 1 << 12), np.uint8)
    for at, bits in parts.toLocalIterator():
        out[at] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(62 - len(bits).bit_length())  # bits has a power of two of bytes
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


class Lexicon(dict):
    """Word -> number in order of appearance; number 0 is the end of a piece. `hashes` are
    those of `word_hash`."""

    def __init__(self, lang: str) -> None:
        super().__init__({b".": 0})
        self.words, self.hashes, self.seed = [b"."], np.zeros(1, np.uint64), xxhash.xxh64_intdigest(lang, 42)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def known(self, frequent: np.ndarray) -> np.ndarray:
        """Whether each word may be frequent."""
        digest, new = xxhash.xxh64_intdigest, self.words[len(self.hashes):]
        self.hashes = np.concatenate((self.hashes, np.array([digest(w, self.seed) for w in new], np.uint64)))
        out = holds(frequent, self.hashes)
        out[0] = False
        return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two word hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Lexicon, np.ndarray]]:
    """(lang, lexicon, word numbers) of about `FLUSH` positions at a time, whole texts."""
    lexicons: dict[str, Lexicon] = {}
    parts: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, Lexicon, np.ndarray]]:
        for lang, own in parts.items():
            yield lang, lexicons[lang], np.concatenate([*own, np.zeros(DEPTH, np.int64)])
        parts.clear()
        if sum(map(len, lexicons.values())) > LEXICON:
            lexicons.clear()

    for lang, raw in by_lang(batches):
        lexicon = lexicons.setdefault(lang, Lexicon(lang))
        own = parts.setdefault(lang, [])
        for words in tokens(raw):
            own.append(np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words)))
            size += len(words)
        own.append(np.zeros(1, np.int64))
        if size >= FLUSH:
            yield from flush()
            size = 0
    yield from flush()


def count_pairs(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(h, n) of the pairs of neighbouring words that both may be frequent, by hash."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lexicon, at in positions(batches):
            good = lexicon.known(held.value)[at]
            first = np.flatnonzero(good[:-1] & good[1:])
            h, n = np.unique(pair_hash(lexicon.hashes[at[first]], lexicon.hashes[at[first + 1]]), return_counts=True)
            yield emit("h long,n long", h.view(np.int64), n)

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def routes(pairs: DataFrame, budget: int) -> np.ndarray:
    """For each bucket of two-word prefixes (first group, number of groups). Neighbouring
    buckets share a group while they fit the budget; a larger one has groups of its own."""
    bucket = F.col("h").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    sizes = np.zeros(1 << BUCKET_BITS, np.int64)
    for at, n in pairs.groupBy(bucket.alias("at")).agg(F.sum("n").alias("n")).collect():
        sizes[at] = n
    out, group, held = np.ones((len(sizes), 2), np.int64), 0, 0
    for at, n in enumerate(sizes.tolist()):
        if held and held + n > budget:
            group, held = group + 1, 0
        out[at] = group, max(1, -(-n // budget))
        if n > budget:
            group, held = group + int(out[at, 1]), 0
        else:
            held += n
    return out


LEAVES = "group long,lang string,leaf string,n long"


def leaves(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, route: np.ndarray, depth: int) -> DataFrame:
    """(group, lang, leaf, n): the truncated suffixes of two words or more, counted per batch.
    The group is even if it holds whole prefixes, odd if they are spread over several groups."""
    held = docs.sparkSession.sparkContext.broadcast((frequent, pairs, route))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, pairs, route = held.value
        for lang, lexicon, at in positions(batches):
            good = lexicon.known(frequent)[at]
            on = np.append(good[:-1] & good[1:], False)
            first = np.flatnonzero(on)
            hashes = pair_hash(lexicon.hashes[at[first]], lexicon.hashes[at[first + 1]])
            on[first] = own = holds(pairs, hashes)
            first, hashes = first[own], hashes[own]
            # one column of word numbers for each level, 0 below the end of the suffix
            levels, open_ = [at[first], at[first + 1]], np.ones(len(first), bool)
            for k in range(2, depth):
                open_ = open_ & on[np.minimum(first + k - 1, len(on) - 1)]
                levels.append(np.where(open_, at[np.minimum(first + k, len(at) - 1)], 0))
            code = np.zeros(len(first), np.int64)
            for level in levels:  # dense numbers of the prefixes, one level deeper each time
                code = np.unique(code * len(lexicon.words) + level, return_inverse=True)[1].ravel()
            _, one, n = np.unique(code, return_index=True, return_counts=True)
            words = lexicon.words
            text = [b" ".join([words[w] for w in row if w]) for row in np.stack(levels, 1)[one].tolist()] if len(one) else []
            start, parts = route[hashes[one] & np.uint64(len(route) - 1)].T
            spread = np.flatnonzero(parts > 1)
            start[spread] += np.array([xxhash.xxh64_intdigest(text[k]) % int(parts[k]) for k in spread.tolist()], np.int64)
            group = start * 2 + (parts > 1)
            yield emit(LEAVES, group, [lang] * len(text), text, n)

    return docs.mapInArrow(run, LEAVES.replace(",", ", "))


NODES = "lang string,phrase string,n long"


def subtree(suffixes: list[str], counts: list[int]) -> Iterator[tuple[int, str, int]]:
    """(words, phrase, count) of every node of two words or more below the sorted suffixes: a
    node is open while suffixes continue it, and takes its children's totals when they close."""
    path: list[str] = []
    total: list[int] = []

    def close(depth: int) -> Iterator[tuple[int, str, int]]:
        while len(path) > depth:
            n = total.pop()
            if len(path) >= 2:
                yield len(path), " ".join(path), n
            path.pop()
            if total:
                total[-1] += n

    for suffix, n in zip(suffixes, counts, strict=True):
        words = suffix.split(" ")
        same = 0
        while same < len(path) and same < len(words) and path[same] == words[same]:
            same += 1
        yield from close(same)
        for w in words[same:]:
            path.append(w)
            total.append(0)
        total[-1] += n
    yield from close(0)


def build(least: int, depth: int):
    """The function that turns one group's leaves into the counts of its nodes: those that
    reach `least`, and of spread prefixes every node that other groups may add to."""
    def run(table: pa.Table) -> pa.Table:
        spread = table.column("group")[0].as_py() % 2 == 1
        summed = table.group_by(["lang", "leaf"]).aggregate([("n", "sum")])
        out: tuple[list, list, list] = ([], [], [])
        for lang in summed.column("lang").unique().to_pylist():
            own = summed.filter(pa.compute.equal(summed.column("lang"), lang))
            rows = sorted(zip(own.column("leaf").to_pylist(), own.column("n_sum").to_pylist(), strict=True), key=lambda r: r[0].split(" "))
            for words, phrase, n in subtree([r[0] for r in rows], [r[1] for r in rows]):
                if n >= least or spread and words < depth:
                    out[0].append(lang)
                    out[1].append(phrase)
                    out[2].append(n)
        return pa.table([pa.array(c, t.type) for c, t in zip(out, arrow_schema(NODES), strict=True)], schema=arrow_schema(NODES))

    return run


def count_phrases(docs: DataFrame, words: DataFrame, least: int, depth: int, budget: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of 2 to `depth` words that occur `least` times or more in `docs`
    (lang, text), whose words are counted in `words`."""
    frequent = bitmap(words.where(F.col("n") >= least).select(word_hash(F.col("lang"), F.col("word")).alias("h")))
    pairs = cut(count_pairs(docs, frequent).where(F.col("n") >= least))
    tree = leaves(docs, frequent, bitmap(pairs), routes(pairs, budget), depth).groupBy("group").applyInArrow(build(least, depth), NODES.replace(",", ", "))
    return tree.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


#: Copies of a single word's count in the join that looks up the parts of phrases: a common word is part of many.
SALT = 16


#: Parts of a lang that are ranked first, so that the task that ranks the whole lang reads `top` rows of each at most.
PARTS = 64


def scored(phrases: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of `phrases` (lang, phrase, n) by their weakest cut."""
    part = "explode(flatten(transform(sequence(1, size(w) - 1), k -> array(named_struct('k', k, 'first', true, 'part', slice(w, 1, k)), named_struct('k', k, 'first', false, 'part', slice(w, k + 1, size(w) - k))))))"
    cuts = (phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
            .select("lang", "phrase", "a", F.expr(part).alias("c"))
            .select("lang", "phrase", "a", "c.k", "c.first", F.array_join("c.part", " ").alias("part"),
                    F.when(F.size("c.part") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALT))).otherwise(F.lit(0)).cast("int").alias("salt")))
    single = words.where(F.col("n") >= least).select(F.col("lang").alias("of"), F.col("word").alias("p"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    counts = single.union(phrases.select("lang", "phrase", "n", F.lit(0)))
    found = cuts.join(counts, (F.col("lang") == F.col("of")) & (F.col("part") == F.col("p")) & (F.col("salt") == F.col("s")))
    by_cut = (found.repartition("lang", "phrase").groupBy("lang", "phrase", "a", "k")
              .agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r")))
    score = F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = by_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("c"))
    return weakest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """The candidates that no longer one holds with four fifths of their count or more."""
    inner = "explode(flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' ')))))"
    longer = candidates.select("lang", "a", F.split("phrase", " ").alias("w")).where("size(w) > 2").select("lang", F.expr(inner).alias("phrase"), "a")
    rows = candidates.select("lang", "phrase", F.struct("a", "l", "r", "score").alias("own"), F.lit(None).cast("long").alias("over"))
    rows = rows.union(longer.select("lang", "phrase", F.lit(None).cast(rows.schema["own"].dataType), "a"))
    met = rows.groupBy("lang", "phrase").agg(F.max("own").alias("own"), F.max("over").alias("over")).where("own is not null")
    held = F.expr("cast(100 as decimal(38,0)) * cast(over as decimal(19,0)) >= cast(80 as decimal(38,0)) * cast(own.a as decimal(19,0))")
    return met.where(~F.coalesce(held, F.lit(False))).select("lang", "phrase", "own.*")


def mine(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each lang of `docs` (lang, text)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = cut(count_words(texts))
    phrases = cut(count_phrases(texts, words, least, depth, budget))
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = maximal(scored(phrases, words, least)).withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    whole = words.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n"))
    return ranked.join(whole, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return mine(docs)


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded
), counts AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS p, count(*) AS f
  FROM starts CROSS JOIN (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), candidates AS (
  SELECT lang, k, p, f, string_split(p, ' ') AS ws FROM counts WHERE k >= 2 AND f >= 30
), cuts AS (
  SELECT c.lang, c.k, c.p, c.f, c.ws, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.k = c.j AND x.p = array_to_string(c.ws[1:c.j], ' ')
  JOIN counts y ON y.lang = c.lang AND y.k = c.k - c.j AND y.p = array_to_string(c.ws[c.j + 1:], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), inner_phrases AS (
  SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS p
  FROM candidates c, (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) v(m, i) WHERE m < c.k AND i + m - 1 <= c.k
), held AS (
  SELECT lang, p, max(f) AS over FROM inner_phrases GROUP BY lang, p
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), ranks AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.f DESC, encode(w.p) ASC) AS rank, w.p AS phrase, w.f AS a, w.l, w.r, t.n, w.score
  FROM weakest w JOIN totals t ON t.lang = w.lang LEFT JOIN held h ON h.lang = w.lang AND h.p = w.p
  WHERE h.over IS NULL OR 100::HUGEINT * h.over < 80::HUGEINT * w.f
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranks WHERE rank <= 2000
"""

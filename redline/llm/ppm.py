"""Language-model score by prediction by partial matching.

Training counts every symbol after its four preceding bytes, over all training
texts, in one pass that also counts tokens. Every context that was seen predicts by
its counts and escapes to the next shorter one with the probability
distinct / (total + distinct), where symbols already offered are excluded; what no
context has seen shares the last escape evenly. A document's code length adds up the
symbols of its lower-cased bytes and one end symbol.

The counts of all contexts stay tables. Those that hold one part in HOT of all
symbols, at most HOT an order, are also sent to every task as a trie, with all their
shorter contexts, which hold as many symbols at least: what follows them is scored
there. Of the other contexts, those with their symbol that hold one part in COMMON of all
symbols, at most COMMON, are sent as two sorted arrays with what they add to a score.
Whatever is left leaves its document as one row per distinct (context, symbol) and meets
its probability in a join. All three ways count a symbol's log10 probability in whole
units of 2^-26, so that sums are exact and don't depend on their order or on the bounds.
That a longer context's symbols are all known to the shorter one makes the exclusion
a number of the longer context: what its symbols hold in the shorter one.

Token counts: tokens are keyed by XXH64. Those that hold one part in 2^20 of all
training tokens are at most 2^20 by that bound and are sent to every task; the
others of each document are joined with their counts, one row per document and
token, and summed per document.

Defined results: a null text is empty; an empty text has the end token and the end
symbol only; without training texts every symbol has probability 1/256 and no token
is known (base_score 0). Equal texts have equal scores; rows of the same id are rows of their
own. Only doc_id and text are read, so other columns may have any name. An empty table
gives an empty result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.common import arrow_schema, cut, fold, slices

ORDER, HOT, COMMON, HEAVY = 4, 1 << 16, 1 << 20, 1 << 20
END = 0xFF  # no byte of UTF-8: ends a text, and stands before its first byte
#: Rows a task holds back to add equal keys before it emits them.
HELD = 1 << 21
#: Logarithms are added in whole parts of it, so that equal texts have equal scores in any order.
UNIT = 1 << 26

# Kinds of counted keys.
GRAM, TOKEN, TEXT = 0, 1, 2


def lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (four bytes before, symbol) of the texts as 40-bit numbers, and their counts."""
    pad = bytes([END]) * ORDER
    data = np.frombuffer(b"".join(pad + r + bytes([END]) for r in raws), np.uint8).astype(np.int64)
    code = np.zeros(len(data) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | data[k:len(data) - ORDER + k]
    ends = np.cumsum([len(r) + ORDER + 1 for r in raws])
    keep = np.ones(len(code), bool)
    for k in range(ORDER):  # windows that run from one text into the next
        keep[ends[:-1] - ORDER + k] = False
    return np.unique(code[keep], return_counts=True)


class Sums:
    """Counts of keys, added up until HELD of them are held."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD:
            self.merge()
            if self.size > HELD // 2:
                yield from self.flush()

    def merge(self) -> None:
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        self.parts = [(keys, np.bincount(at, np.concatenate([c for _, c in self.parts])).astype(np.int64))]
        self.size = len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            keys, counts = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys), pa.array(counts)], schema=arrow_schema(COUNTED))
        self.parts, self.size = [], 0


COUNTED = "kind int,key long,n long"


def token_keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def count(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts of `docs`: context and symbol, token, and texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, token, texts = Sums(GRAM), Sums(TOKEN), 0
        for batch in batches:
            for part in slices(batch):
                raws = [lower(t) for t in part.column(0).to_pylist()]
                texts += len(raws)
                if not raws:
                    continue
                yield from context.add(*grams(raws))
                words = Counter()
                for r in raws:
                    words.update(r.split())
                yield from token.add(token_keys(list(words)), np.fromiter(words.values(), np.int64, len(words)))
        yield from context.flush()
        yield from token.flush()
        yield pa.RecordBatch.from_arrays([pa.array([TEXT], pa.int32()), pa.array([0]), pa.array([texts])], schema=arrow_schema(COUNTED))

    return docs.select("text").mapInArrow(run, COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """The kept contexts per order, sorted, and their nodes, shortest contexts first.
    Bytes that training never saw are alike for every context and share the last column."""
    contexts: list[np.ndarray]
    counts: np.ndarray
    parent: np.ndarray
    column: np.ndarray  # byte -> column
    unseen: int

    @staticmethod
    def of(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
        """levels: (context, symbol, n) of every kept context, per order."""
        contexts = [np.unique(ctx) for ctx, _, _ in levels]
        contexts[0] = np.zeros(1, np.int64)
        base = np.cumsum([0, *map(len, contexts)])
        seen = np.unique(levels[0][1])
        column = np.full(256, len(seen))
        column[seen] = np.arange(len(seen))
        counts = np.zeros((base[-1], len(seen) + 1))
        parent = np.zeros(base[-1], np.int64)
        for k, (ctx, sym, n) in enumerate(levels):
            counts[base[k] + np.searchsorted(contexts[k], ctx), column[sym]] = n
            if k > 0:
                shorter = contexts[k] & ((1 << 8 * (k - 1)) - 1)
                parent[base[k]:base[k + 1]] = base[k - 1] + np.searchsorted(contexts[k - 1], shorter)
        return Trie(contexts, counts, parent, column, 256 - len(seen))

    def log10(self) -> np.ndarray:
        """log10 probability, in units, of each column's symbol after each context: counts, escapes, exclusion."""
        out = np.empty(self.counts.shape, np.int32)
        for at in range(0, len(out), 2048):
            node = np.arange(at, min(at + 2048, len(out)))
            p, left = np.zeros((len(node), out.shape[1])), np.ones(len(node))
            seen = np.zeros(p.shape, bool)
            for _ in range(len(self.contexts)):
                c = np.where(seen, 0, self.counts[node])
                total, kinds = c.sum(1), (c > 0).sum(1)
                some = kinds > 0
                norm = np.where(some, total + kinds, 1.0)
                p += left[:, None] * c / norm[:, None]
                left = np.where(some, left * kinds / norm, left)
                seen |= c > 0
                node = self.parent[node]  # the empty context is its own parent and by then excluded
            rest = (~seen[:, :-1]).sum(1) + self.unseen
            out[at:at + 2048] = np.rint(UNIT * np.log10(np.where(seen, p, (left / np.maximum(rest, 1))[:, None])))
        return out

    def children(self) -> np.ndarray:
        """node x column of the preceding byte -> the longer context's node, -1 if it isn't kept."""
        base = np.cumsum([0, *map(len, self.contexts)])
        child = np.full((base[-1], self.counts.shape[1]), -1, np.int32)
        for k in range(1, len(self.contexts)):
            own = np.arange(base[k], base[k + 1])
            child[self.parent[own], self.column[self.contexts[k] >> 8 * (k - 1)]] = own
        return child


class Scorer:
    def __init__(self, trie: Trie, common: tuple[np.ndarray, np.ndarray]):
        self.logp, self.child, self.column = trie.log10(), trie.children(), trie.column.astype(np.uint8)
        self.grams, self.units = common

    def score(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """log10 probability, in units, of the bytes and the end that follow the trie's
        longest contexts or make up a common gram, and the distinct (context, symbol) of
        all others with their counts."""
        total, block, cold = 0, 1 << 20, []
        data = np.frombuffer(bytes([END]) * ORDER + raw + bytes([END]), np.uint8)
        for at in range(ORDER, len(data), block):
            near = data[at - ORDER:at + block]
            own = self.column[near]
            n = len(own) - ORDER
            node, live = np.zeros(n, np.int32), np.ones(n, bool)
            for k in range(1, ORDER + 1):
                longer = self.child[node, own[ORDER - k:ORDER - k + n]]
                live &= longer >= 0  # a context that isn't in the trie has no longer ones there
                node = np.where(live, longer, node)
            total += int(self.logp[node[live], own[ORDER:][live]].sum(dtype=np.int64))
            rest = np.flatnonzero(~live)
            code = np.zeros(len(rest), np.int64)
            for k in range(ORDER + 1):
                code = code << 8 | near[rest + k]
            cold.append(code)
        grams, n = np.unique(np.concatenate(cold), return_counts=True)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            hit = self.grams[at] == grams
            total += int((n[hit] * self.units[at[hit]]).sum())
            grams, n = grams[~hit], n[~hit]
        return total, grams, n


def ending(gram: Column, size: int) -> Column:
    """The last `size` bytes of a number."""
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1))


def context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def tables(contexts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order, (gram, n) of every context with its symbol, and (ctx, total, kinds,
    rest, more) of every context: the symbols after it, how many differ, and what the
    next shorter context has besides those: its denominator and its distinct symbols.
    From (key, n) of the longest order. No key of the joins has over 256 rows."""
    every, grams = contexts.select(F.col("key").alias("gram"), "n"), []
    for k in reversed(range(ORDER + 1)):
        if k < ORDER:
            every = cut(every.groupBy(ending(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n")))
        grams.insert(0, every)
    sums = F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")
    none = F.lit(None).cast("long")
    nodes = [cut(grams[0].groupBy(context(F.col("gram")).alias("ctx")).agg(*sums).withColumn("rest", none).withColumn("more", none))]
    for k in range(1, ORDER + 1):
        shorter = grams[k - 1].select(F.col("gram").alias("end"), F.col("n").alias("m"))
        own = grams[k].join(shorter, ending(F.col("gram"), k) == F.col("end")).groupBy(context(F.col("gram")).alias("ctx")).agg(*sums, F.sum("m").alias("inner"))
        above = nodes[k - 1].select(F.col("ctx").alias("c"), F.col("total").alias("t"), F.col("kinds").alias("q"))
        more = F.col("q") - F.col("kinds")
        nodes.append(cut(own.join(above, ending(F.col("ctx"), k - 1) == F.col("c"))
                         .select("ctx", "total", "kinds", (F.col("t") - F.col("inner") + more).alias("rest"), more.alias("more"))))
    return grams, nodes


def levels(grams: list[DataFrame], nodes: list[DataFrame], whole: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, symbol, n) per order of the trie that is sent. At most HOT contexts of
    an order hold `whole` / HOT symbols, which bounds what is collected."""
    out = []
    for k, each in enumerate(grams):
        if k > 1:
            hot = nodes[k].where(F.col("total") * HOT >= whole).select(F.col("ctx").alias("c"))
            each = each.join(F.broadcast(hot), context(F.col("gram")) == F.col("c"), "left_semi")
        rows = each.select(context(F.col("gram")).alias("ctx"), ending(F.col("gram"), 1).alias("sym"), "n").toPandas()
        out.append(tuple(rows[c].to_numpy(np.int64) for c in ("ctx", "sym", "n")))
    return out


def units(log: Column) -> Column:
    return F.rint(log * UNIT).cast("long")


def common(grams: DataFrame, nodes: DataFrame, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the longest order that hold `whole` / COMMON symbols, ascending, but for
    those of the contexts that the trie holds, and their log10 probabilities in units. At
    most COMMON are collected: together they hold no more than `whole`."""
    often = grams.where(F.col("n") * COMMON >= whole)
    cold = nodes.where(F.col("total") * HOT < whole)
    rows = often.join(cold, context(F.col("gram")) == F.col("ctx")).select("gram", units(F.log10("n") - F.log10(F.col("total") + F.col("kinds"))).alias("u")).toPandas()
    rows = rows.sort_values("gram")
    return rows["gram"].to_numpy(np.int64), rows["u"].to_numpy(np.int64)


def probabilities(asked: DataFrame, grams: list[DataFrame], nodes: list[DataFrame], k: int = ORDER) -> DataFrame:
    """(gram, n, start, after) of distinct grams `asked` (gram) of order k: the count,
    log10 of the probability from that context on, and of that after its escape (only
    where n is null). What a context hasn't seen is asked of the next shorter one, once."""
    own = cut(asked.join(grams[k].withColumnRenamed("gram", "g"), F.col("gram") == F.col("g"), "left").drop("g")
              .join(nodes[k], context(F.col("gram")) == F.col("ctx"), "left"))
    if k:
        short = ending(F.col("gram"), k)
        lower = probabilities(own.where("n is null").select(short.alias("gram")).distinct(), grams, nodes, k - 1)
        lower = lower.select(F.col("gram").alias("g"), F.col("n").alias("m"), F.col("start").alias("shorter"), F.col("after").alias("further"))
        own = own.join(lower, short == F.col("g"), "left")
        escape = F.when(F.col("more") > 0, F.log10("more") - F.log10("rest")).otherwise(0.0)
        after = F.when(F.col("m").isNotNull(), F.log10("m") - F.log10("rest")).otherwise(escape + F.col("further"))
        unseen = F.col("shorter")
    else:
        after = unseen = -F.log10(F.lit(256) - F.coalesce("kinds", F.lit(0)))
    all_of = F.col("total") + F.col("kinds")
    start = (F.when(F.col("n").isNotNull(), F.log10("n") - F.log10(all_of))
             .when(F.col("ctx").isNotNull(), F.log10("kinds") - F.log10(all_of) + after).otherwise(unseen))
    return own.select("gram", "n", start.alias("start"), after.alias("after"))


_READY: dict[int, Scorer] = {}

SCORED = "doc_id long,n_tokens long,known long,logs double,score long,others array<long>,times array<int>,cold array<long>,often array<int>"


def score_texts(docs: DataFrame, kept: list, often: tuple[np.ndarray, np.ndarray], heavy: tuple[np.ndarray, np.ndarray], ends: int, mark: int) -> DataFrame:
    """Per row: tokens, how many of the heavy ones and the sum of log10(c + 0.5) over
    them, the part of the score that needs no join, the keys and counts of all other
    tokens, and those of the contexts with their symbols that are left."""
    sent = docs.sparkSession.sparkContext.broadcast((kept, often, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common, (keys, counts) = sent.value
        if mark not in _READY:
            _READY.clear()
            _READY[mark] = Scorer(Trie.of(model), common)
        scorer, logs = _READY[mark], np.log10(counts + 0.5)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = lower(text)
                    words = Counter(raw.split())
                    own, n = token_keys(list(words)), np.fromiter(words.values(), np.int64, len(words))
                    order = np.argsort(own)
                    own, n = own[order], n[order]
                    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                    hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                    known, cold, often = scorer.score(raw)
                    rows.append((doc_id, int(n.sum()) + 1, int(n[hit].sum()) + (ends > 0), float((n[hit] * logs[at[hit]]).sum() + np.log10(ends + 0.5)),
                                 known, own[~hit], n[~hit].astype(np.int32), cold, often.astype(np.int32)))
                types = arrow_schema(SCORED)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of
    docs (doc_id, text), learned from the rows that `training` selects."""
    counts = cut(count(docs.where(training)))
    contexts, tokens = counts.where(F.col("kind") == GRAM), counts.where(F.col("kind") == TOKEN).select("key", "n")
    symbols = contexts.agg(F.sum("n")).first()[0] or 0
    ends = counts.where(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    train, vocabulary = tokens.agg(F.sum("n"), F.count(F.lit(1))).first()
    train, vocabulary = (train or 0) + ends, vocabulary + (ends > 0)
    top = tokens.where(F.col("n") * HEAVY >= train).toPandas().sort_values("key")
    heavy = top["key"].to_numpy(np.int64), top["n"].to_numpy(np.float64)
    grams, nodes = tables(contexts)
    kept, often = levels(grams, nodes, symbols), common(grams[ORDER], nodes[ORDER], symbols)
    mark = hash((symbols, ends, train, vocabulary, counts.inputFiles()[0] if ends else ""))
    scored = cut(score_texts(docs, kept, often, heavy, ends, mark).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("others", "times")).alias("t")).select("row", F.col("t.others").alias("of"), F.col("t.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    words = (rare.join(tokens.where(F.col("n") * HEAVY < train), F.col("of") == F.col("key"), "left")
             .select("row", F.when(c > 0, F.col("times")).otherwise(0).alias("more"), (F.col("times") * F.log10(c + 0.5)).alias("sums"), F.lit(None).cast("long").alias("bits")))
    cold = scored.select("row", F.explode(F.arrays_zip("cold", "often")).alias("t")).select("row", F.col("t.cold").alias("of"), F.col("t.often").alias("times"))
    each = probabilities(cold.select(F.col("of").alias("gram")).distinct(), grams, nodes).select("gram", "start")
    symbol = cold.join(each, F.col("of") == F.col("gram")).select("row", F.lit(0).alias("more"), F.lit(0.0).alias("sums"), (F.col("times") * units(F.col("start"))).alias("bits"))
    summed = words.union(symbol).groupBy(F.col("row").alias("r")).agg(F.sum("more").alias("more"), F.sum("sums").alias("sums"), F.sum("bits").alias("bits"))
    whole = float(np.log10(train + 0.5 * (vocabulary + 1)))
    base = F.col("logs") + F.coalesce("sums", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)
    return (scored.drop("others", "times", "cold", "often").join(summed, F.col("row") == F.col("r"), "left")
            .select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(train)).cast("long").alias("train_tokens"),
                    (base if train else F.lit(0.0)).alias("base_score"), ((F.col("score") + F.coalesce("bits", F.lit(0))) / F.lit(float(UNIT))).alias("score")))


def query(docs: DataFrame) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 1
    out = score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

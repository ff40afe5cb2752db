"""Byte-level BPE encoding and decoding of whole texts.

Words are cut by the tokenizer's public pattern. For a short word the part
boundaries and the ranks of adjacent pairs are held in contiguous arrays: the
minimum rank is found by a scan, its boundary is deleted, the ranks of the two
neighbours are refreshed, until no pair has a rank. All new words of a batch that
have the same length are the rows of one matrix, so that a scan serves them all.
Long words keep the same order of merges with a heap over linked parts.

Defined results: a null text is empty; an empty text has no tokens and decodes to "".
The special token's string in a text becomes the special token, as in the library. Of pairs
of equal rank the leftmost merges first. Rows of the same id are encoded each by its own
text. Only doc_id and text are read, so other columns may have any name. An empty table
gives an empty result."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from redline.llm.common import arrow_schema, slices

#: Bytes up to which a word is merged in the matrix, and words that a worker remembers.
SHORT, REMEMBER = 48, 400_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """The public byte-to-letter rule: printable Latin-1 bytes stand for themselves,
    the others for the letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Tokenizer:
    def __init__(self, spec: str, pattern: str):
        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = special
        self.bytes_of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.lookup = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.words = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.spelled: dict[bytes, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of one length: a row of parts and a row of adjacent ranks each."""
        n, width = len(words), len(words[0])
        parts = self.first[np.frombuffer(b"".join(words), np.uint8).reshape(n, width)]
        out: list[list[int]] = [[]] * n
        row = np.arange(n)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:]) if width > 1 else np.empty((n, 0), np.int32)
        while len(row):
            size = ranks.shape[1]
            if size:
                at = ranks.argmin(1)
                low = ranks[np.arange(len(row)), at]
                over = low == NONE
            else:
                over = np.ones(len(row), bool)
            if over.any():
                for r, ids in zip(row[over].tolist(), parts[over].tolist(), strict=True):
                    out[r] = ids
                go = ~over
                row, parts, ranks = row[go], parts[go], ranks[go]
                if not len(row):
                    break
                at, low = at[go], low[go]
            # delete the boundary after part `at`: all rows lose one part
            each, step = np.arange(len(row)), np.arange(size)
            parts = np.take_along_axis(parts, step + (step > at[:, None]), 1)
            parts[each, at] = self.merged[low]
            ranks = np.take_along_axis(ranks, step[:-1] + (step[:-1] >= at[:, None]), 1)
            if size > 1:
                has = at < size - 1
                ranks[each[has], at[has]] = self.ranks(parts[each[has], at[has]], parts[each[has], at[has] + 1])
                has = at > 0
                ranks[each[has], at[has] - 1] = self.ranks(parts[each[has], at[has] - 1], parts[each[has], at[has]])
        return out

    def long(self, word: bytes) -> list[int]:
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        get, merged = self.lookup.get, self.merged
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            if ids[k] != a or (n := after[k]) < 0 or ids[n] != b:
                continue
            ids[k], ids[n], after[k] = int(merged[r]), -1, after[n]
            if after[n] >= 0:
                before[after[n]] = k
                if (x := get(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
            if before[k] >= 0 and (x := get(ids[before[k]] << 20 | ids[k])) is not None:
                heapq.heappush(heap, (x, before[k], ids[before[k]], ids[k]))
        return [i for i in ids if i >= 0]

    def learn(self, words: set[str]) -> None:
        """Add the ids of new words, as decimals joined by commas."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            by_size.setdefault(len(raw), []).append((w, raw))
        for size, own in by_size.items():
            ids = self.short([raw for _, raw in own]) if size <= SHORT else [self.long(raw) for _, raw in own]
            for (w, _), one in zip(own, ids, strict=True):
                self.known[w] = ",".join(map(str, one)).encode()

    def pieces(self, text: str) -> list[str]:
        if not self.special or not self.special.search(text):
            return self.words.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                self.known.setdefault(part, b"%d" % self.special_ids[part])
                out.append(part)
            else:
                out += self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Per text its words' ids; the words' lists joined are the text's ids."""
        if len(self.known) > REMEMBER:
            self.known.clear()
            self.spelled.clear()
        cut = [self.pieces(t) for t in texts]
        known = self.known
        new = set()
        for words in cut:
            new.update(w for w in words if w not in known)
        self.learn(new)
        return [[known[w] for w in words] for words in cut]

    def spell(self, ids: bytes) -> bytes:
        got = self.spelled.get(ids)
        if got is None:
            got = self.spelled[ids] = b"".join(self.bytes_of[int(i)] for i in ids.split(b","))
        return got

    def decode(self, runs: list[bytes]) -> str:
        return b"".join(map(self.spell, runs)).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def loaded(spec: str, pattern: str) -> Tokenizer:
    """One tokenizer per worker process, with the words it has met."""
    key = hashlib.sha256((spec + pattern).encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(spec, pattern)
    return _LOADED[key]


SCHEMA = "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row. The driver
    reads the vocabulary file (a fixed 2 MB) and sends it along; executors need no file."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = SCHEMA + (",ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(spec.value, pattern)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                ids, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
                cols: list[list] = [[] for _ in schema.split(",")[1:]]
                for runs in tok.encode(texts):
                    said = b",".join(runs)
                    row = [said.count(b",") + 1 if runs else 0, hashlib.sha256(said).hexdigest(), hashlib.sha256(tok.decode(runs).encode()).hexdigest()]
                    if with_ids:
                        row.append(np.fromstring(said, np.int32, sep=",") if runs else np.empty(0, np.int32))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(cols, list(types)[1:], strict=True))], schema=types)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def query(docs: DataFrame) -> DataFrame:
    return encode_documents(docs, *public_vocabulary())

"""R-07: edit extraction by Levenshtein token alignment.

The common prefix and suffix are trimmed first (R-08's trimming), so the
alignment only runs on the differing middle; that middle is
aligned by a small Arrow-batched helper (a per-row dynamic program has no
built-in form). Merging: 'all-split' (one edit per operation), 'all-merge'
(adjacent non-matches merged), 'all-equal' (adjacent operations of the same
kind merged). Types are M / U / R (missing, unnecessary, replacement).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDIT_T = T.ArrayType(T.StructType([T.StructField("o_start", T.IntegerType()),
                                   T.StructField("o_end", T.IntegerType()),
                                   T.StructField("c_str", T.StringType()),
                                   T.StructField("type", T.StringType())]))


#: Cells of an alignment matrix held at once; longer pairs are aligned along diagonals.
CELLS = 1 << 20
#: Distance up to which diagonals are searched; pairs further apart are halved.
FAR = 1 << 12


def _costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of `a` to every prefix of `b`, one row at a time."""
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for k, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


def align_ops(a: list, b: list) -> list:
    """Levenshtein alignment of a -> b as (op, i, j) with op in M(atch)/S/D/I;
    ties prefer match, then substitution, deletion, insertion. A pair whose
    matrix would exceed CELLS is searched diagonal by diagonal, which costs its
    length and the square of its distance, not the product of its lengths. If its
    distance exceeds FAR, it is split where the distances of its halves add up to the
    least. Memory stays bounded and the alignment optimal in all three ways. Where few
    operations are enough, a small pair's matrix isn't filled: `near_ops` gives the same."""
    if (len(a) + 1) * (len(b) + 1) <= CELLS:
        ops = near_ops(a, b)
        if ops is not None:
            return ops
    ids: dict = {}
    return _align(np.array([ids.setdefault(x, len(ids)) for x in a], np.int64), np.array([ids.setdefault(x, len(ids)) for x in b], np.int64))


def near_ops(a: list, b: list) -> list | None:
    """The alignment that the whole matrix gives, ties included, from the furthest places in
    `a` that 0, 1, 2, ... operations reach on each diagonal (place in b less place in a): a cell
    costs at most d where d operations reach it. None if more operations are needed than pay."""
    n, m = len(a), len(b)
    far = int((4 * min(n, m)) ** 0.5) + 2
    if abs(n - m) > far:
        return None
    reached: list[dict] = []
    while not reached or reached[-1].get(m - n, -1) < n:
        d = len(reached)
        if d > far:
            return None
        last, row = reached[-1] if d else {}, {}
        for k in range(max(-d, -n), min(d, m) + 1):
            i = max(last.get(k, -2) + 1, last.get(k - 1, -2), last.get(k + 1, -2) + 1) if d else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            row[k] = i
        reached.append(row)
    ops, i, j, d = [], n, m, len(reached) - 1
    while i > 0 or j > 0:
        if i > 0 and j > 0 and a[i - 1] == b[j - 1]:
            ops.append(("M", i - 1, j - 1))
            i, j = i - 1, j - 1
            continue
        d -= 1
        if i > 0 and j > 0 and reached[d].get(j - i, -1) >= i - 1:
            ops.append(("S", i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i > 0 and reached[d].get(j - i + 1, -1) >= i - 1:
            ops.append(("D", i - 1, j))
            i -= 1
        else:
            ops.append(("I", i, j - 1))
            j -= 1
    return ops[::-1]


def _run(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, block: int = 32) -> np.ndarray:
    """How far equal tokens go on from each (i, j), all pairs at once; `a` and `b` end in
    `block` guards that equal nothing."""
    out, live, steps = np.zeros(len(i), np.int64), np.arange(len(i)), np.arange(block)
    while len(live):
        same = a[(i[live] + out[live])[:, None] + steps] == b[(j[live] + out[live])[:, None] + steps]
        whole = same.all(1)
        out[live] += np.where(whole, block, (~same).argmax(1))
        live = live[whole]
    return out


def _reach(last: np.ndarray, low: int, a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[np.ndarray, int]:
    """The furthest place in `a` that one more operation reaches on each diagonal (place in b
    less place in a), from those of `last`, whose first diagonal is `low`; -1 where none."""
    new_low = max(low - 1, -n)
    k = np.arange(new_low, min(low + len(last), m) + 1)
    padded = np.concatenate((np.full(2, -2), last, np.full(2, -2)))
    at = k - low + 2
    change, insert, delete = padded[at] + 1, padded[at - 1], padded[np.minimum(at + 1, len(padded) - 1)] + 1
    i = np.minimum(np.maximum(np.maximum(change, insert), delete), np.minimum(n, m - k))
    some = (i >= 0) & (i + k >= 0)
    i = np.where(some, i, -1)
    on = np.flatnonzero(some)
    i[on] += _run(a, b, i[on], i[on] + k[on])
    return i, new_low


def diagonal_ops(a: np.ndarray, b: np.ndarray, far: int | None = None) -> list | None:
    """Levenshtein alignment by the furthest places that 0, 1, 2, ... operations reach on
    every diagonal; None if more than `far` are needed. Every so many rows of places are
    kept; the walk back makes the rows between them again."""
    far = FAR if far is None else far
    n, m = len(a), len(b)
    pad_a, pad_b = np.concatenate((a, np.full(64, -1))), np.concatenate((b, np.full(64, -2)))
    step = max(1, int(far ** 0.5))
    row, low = np.array([0]), 0
    row = row + _run(pad_a, pad_b, row, row)
    kept, d = [(row, low)], 0
    while not (low <= m - n < low + len(row) and row[m - n - low] == n):
        d += 1
        if d > far:
            return None
        row, low = _reach(row, low, pad_a, pad_b, n, m)
        if d % step == 0:
            kept.append((row, low))
    ops, i, k, rows = [], n, m - n, {}

    def place(d: int, k: int) -> int:
        if d not in rows:
            rows.clear()
            at = d - d % step
            rows[at] = kept[at // step]
            for e in range(at + 1, at + step):
                rows[e] = _reach(*rows[e - 1], pad_a, pad_b, n, m)
        row, low = rows[d]
        return int(row[k - low]) if low <= k < low + len(row) else -2

    while d:
        # where the last operation left off: a change, a deletion or an insertion
        change, delete, insert = place(d - 1, k) + 1, place(d - 1, k + 1) + 1, place(d - 1, k - 1)
        at = min(max(change, delete, insert), n, m - k)
        ops += [("M", x, x + k) for x in range(i - 1, at - 1, -1)]
        if change >= at and change > 0 and at + k > 0:
            ops.append(("S", at - 1, at + k - 1))
            i = at - 1
        elif delete >= at and delete > 0:
            ops.append(("D", at - 1, at + k))
            i, k = at - 1, k + 1
        else:
            ops.append(("I", at, at + k - 1))
            i, k = at, k - 1
        d -= 1
    return (ops + [("M", x, x) for x in range(i - 1, -1, -1)])[::-1]


def _align(a: np.ndarray, b: np.ndarray) -> list:
    n, m = len(a), len(b)
    if (n + 1) * (m + 1) > CELLS and n > 1:
        ops = diagonal_ops(a, b)
        if ops is not None:
            return ops
        half = n // 2
        cut = int((_costs(a[:half], b) + _costs(a[half:][::-1], b[::-1])[::-1]).argmin())
        return _align(a[:half], b[:cut]) + [(op, i + half, j + cut) for op, i, j in _align(a[half:], b[cut:])]
    steps = np.arange(m + 1)
    d = np.empty((n + 1, m + 1), np.int64)
    d[0] = steps
    for i in range(1, n + 1):
        d[i, 0] = i
        d[i, 1:] = np.minimum(d[i - 1, :-1] + (b != a[i - 1]), d[i - 1, 1:] + 1)
        d[i] = np.minimum.accumulate(d[i] - steps) + steps
    ops, i, j = [], n, m
    while i > 0 or j > 0:
        same = i > 0 and j > 0 and a[i - 1] == b[j - 1]
        if i > 0 and j > 0 and d[i, j] == d[i - 1, j - 1] + (not same):
            ops.append(("M" if same else "S", i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i > 0 and d[i, j] == d[i - 1, j] + 1:
            ops.append(("D", i - 1, j))
            i -= 1
        else:
            ops.append(("I", i, j - 1))
            j -= 1
    return ops[::-1]


def _edit(a_start, a_end, b_toks):
    c = " ".join(b_toks)
    typ = "M" if a_start == a_end else ("U" if not b_toks else "R")
    return {"o_start": a_start, "o_end": a_end, "c_str": c, "type": typ}


def ops_to_edits(ops, b: list, merge: str) -> list:
    groups, cur = [], []
    for op in ops:
        if op[0] == "M":
            if cur:
                groups.append(cur)
                cur = []
            continue
        if cur and merge == "all-equal" and cur[-1][0] != op[0]:
            groups.append(cur)
            cur = []
        if cur and merge == "all-split":
            groups.append(cur)
            cur = []
        cur.append(op)
    if cur:
        groups.append(cur)
    out = []
    for g in groups:
        a_idx = [i for op, i, _ in g if op in ("S", "D")]
        start = a_idx[0] if a_idx else g[0][1]
        end = a_idx[-1] + 1 if a_idx else start
        out.append(_edit(start, end, [b[j] for op, _, j in g if op in ("S", "I")]))
    return out


def _prefix(a: list, b: list, least: int) -> int:
    """Length of the common prefix, at most `least`; stretches are compared whole."""
    p = 0
    while p < least and a[p:p + 64] == b[p:p + 64]:
        p += 64
    return next((k for k in range(p, least) if a[k] != b[k]), least)


def _trimmed(a: list, b: list, merge: str = "all-merge") -> list:
    """Edits of whole token lists: their middles between common prefix and suffix aligned."""
    if a == b:
        return []
    least = min(len(a), len(b))
    p = _prefix(a, b, least)
    q = _prefix(a[::-1], b[::-1], least - p) if p < least else 0
    own = b[p:len(b) - q]
    return [e | {"o_start": e["o_start"] + p, "o_end": e["o_end"] + p} for e in ops_to_edits(align_ops(a[p:len(a) - q], own), own, merge)]


def pair_edits(pairs: Column) -> Column:
    """Merged edits of STRUCT<s, t> token arrays; NULL where the struct is or both are empty."""
    @F.pandas_udf(EDIT_T)
    def run(pair: pd.DataFrame) -> pd.Series:
        return pd.Series([None if a is None or b is None or not len(a) + len(b) else _trimmed(list(a), list(b)) for a, b in zip(pair["s"], pair["t"], strict=True)], dtype=object)
    return run(pairs)


def _make_udf(merge: str):
    @F.pandas_udf(EDIT_T)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _trimmed(list(x), list(y), merge) for x, y in zip(a, b, strict=True)], dtype=object)
    return run


_UDFS: dict = {}


def levenshtein_edits(src_tok, tgt_tok, merge: str = "all-merge") -> Column:
    """Token edits src -> tgt by Levenshtein alignment of the differing
    middle (offsets in the source). Equal arrays reach the helper empty."""
    if merge not in ("all-split", "all-merge", "all-equal"):
        raise ValueError("merge must be all-split, all-merge or all-equal")
    if merge not in _UDFS:
        _UDFS[merge] = _make_udf(merge)
    s = F.col(src_tok) if isinstance(src_tok, str) else src_tok
    t = F.col(tgt_tok) if isinstance(tgt_tok, str) else tgt_tok
    return _UDFS[merge](F.when(s == t, F.slice(s, 1, 0)).otherwise(s), F.when(s == t, F.slice(t, 1, 0)).otherwise(t))

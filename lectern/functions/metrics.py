"""Alignment and error rates. Distances are the built-in levenshtein for short texts and bit vectors for whole
documents; those, splits and opcodes need Python."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from difflib import Match, SequenceMatcher
from functools import cached_property
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import evaluation_forms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INTS = lambda *names: [T.StructField(n, T.IntegerType()) for n in names]
# types, not DDL: importing must not need a session
OPCODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *_INTS("i1", "i2", "j1", "j2")]))
SPLIT = T.StructType(_INTS("substitutions", "deletions", "insertions"))

#: The base of window hashes; any odd number has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
#: Rows of a batch that are held as Python's texts at once.
PIECE = 500


def split_edits(reference: str, hypothesis: str) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of one minimal alignment."""
    return split_many([reference], [hypothesis])[0]


def split_many(references: list[str], hypotheses: list[str], cells: int = 1 << 16) -> list[tuple[int, int, int]]:
    """Splits of many pairs, in memory linear in the references, pairs of like lengths side by side.

    Where bounds of the distance meet, there is only one split. Else cells go by antidiagonals. A cell takes
    its diagonal neighbour where characters agree, else the first of substitution, deletion, insertion that is
    minimal, which is the path a backtrace would take. Pairs of more than ``cells`` cells go by bit vectors,
    with the same path.
    """
    out = [_met(r, h) or (_long_split(r, h) if len(r) * len(h) > cells else None) for r, h in zip(references, hypotheses, strict=True)]
    left = [k for k, found in enumerate(out) if found is None]
    pairs = {k: (_codes(references[k]).astype(np.int64), _codes(hypotheses[k]).astype(np.int64)) for k in left}
    order = sorted(left, key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        take = max(1, min(len(order), cells // (len(pairs[order[-1]][0]) + 1)))
        part, order = order[-take:], order[:-take]
        for k, v in zip(part, _diagonals([pairs[k] for k in part]), strict=True):
            out[k] = v
    return out


def _diagonals(pairs):
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    wide, tall = int(n.max()), int(m.max())
    a, b = np.full((len(pairs), wide), -1), np.full((len(pairs), tall), -2)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = x, y
    # first axis: distance, substitutions, deletions, insertions; last: after i reference characters
    one, two = (np.zeros((4, len(pairs), wide + 1), np.int32) for _ in range(2))
    out, ends = [(0, 0, 0)] * len(pairs), n + m
    for d in range(1, int(ends.max()) + 1):
        now = np.zeros_like(one)
        lo, hi = max(0, d - tall), min(wide, d)
        if lo == 0:
            now[[0, 3], :, 0] = d
        if hi == d:
            now[[0, 2], :, d] = d
        x, y = max(lo, 1), min(hi, d - 1)
        if x <= y:
            same = a[:, x - 1 : y] == b[:, d - y - 1 : d - x][:, ::-1]
            diag, up, left = two[:, :, x - 1 : y], one[:, :, x - 1 : y], one[:, :, x : y + 1]
            best = np.minimum(np.minimum(diag[0], up[0]), left[0])
            sub = ~same & (diag[0] == best)
            cut = ~same & ~sub & (up[0] == best)
            put = ~(same | sub | cut)
            cell = np.where(same | sub, diag, np.where(cut, up, left))
            cell[0] += ~same
            cell[1] += sub
            cell[2] += cut
            cell[3] += put
            now[:, :, x : y + 1] = cell
        one, two = now, one
        for k in np.flatnonzero(ends == d):
            out[k] = tuple(int(v) for v in one[1:, k, n[k]])
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _shared(a: str, b: str, i: int = 0, j: int = 0, step: int = 64) -> int:
    """Length of what a from i and b from j have in common at the start."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = n + step, 2 * step
    if n >= most:
        return most
    while step > 1:
        step //= 2
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
    return min(n, most)


def _within_order(a: str, b: str) -> bool:
    """Whether b is a with some characters left out; runs are matched as early as they can be."""
    i = j = 0
    while j < len(b):
        i = a.find(b[j], i)
        if i < 0 or len(a) - i < len(b) - j:
            return False
        n = _shared(a, b, i, j, 16)
        i, j = i + n, j + n
    return True


def _met(a: str, b: str) -> tuple[int, int, int] | None:
    """The split, by bounds in linear time, or None where they do not meet.

    No alignment can match more of a character than both texts have, so the distance is at least what either has in
    surplus. Where the texts differ in as many places, or one is the other with characters left out, it is no more. Then
    there is one split: each character in surplus is changed or lost, so nothing is put in that a length does not ask for.
    """
    n, m = len(a), len(b)
    if a == b:
        return 0, 0, 0
    if n < m:
        s, d, i = _met(b, a) or (None, 0, 0)
        return None if s is None else (s, i, d)
    if a.startswith(b):
        return 0, n - m, 0
    x, y = _codes(a), _codes(b)
    if n == m:
        lost, put = (set(c[x != y].tolist()) for c in (x, y))
        return (int((x != y).sum()), 0, 0) if lost.isdisjoint(put) else None
    if max(x.max(), y.max()) >= 1 << 16:
        both = np.unique(np.r_[x, y], return_inverse=True)[1]
        x, y = both[:n], both[n:]
    size = int(max(x.max(), y.max())) + 1
    held = np.bincount(y, minlength=size)
    more = np.bincount(x, minlength=size) - held
    if (more < 0).any():
        return None
    kinds = np.flatnonzero(more)
    if not held[kinds].any():
        fits = (x[held[x] > 0] == y).all()
    elif len(kinds) == 1:
        # the other characters agree, and between two of them no more of this one stand in b than in a
        at, to = np.flatnonzero(x != kinds[0]), np.flatnonzero(y != kinds[0])
        fits = (x[at] == y[to]).all() and (np.diff(to, prepend=-1, append=m) <= np.diff(at, prepend=-1, append=n)).all()
    else:
        fits = _within_order(a, b)
    return (0, n - m, 0) if fits else None


def _places(text: str) -> dict[str, int]:
    """Each character with a bit set at every place where it stands."""
    code = _codes(text)
    return {chr(c): int.from_bytes(np.packbits(code == c, bitorder="little").tobytes(), "little") for c in np.unique(code)}


def _column(eq: int, vp: int, vn: int, mask: int) -> tuple[int, int, int]:
    """One column of the matrix: unchanged diagonals, vertical rises and vertical falls, a bit a row (Myers, Hyyrö)."""
    d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
    hp = ((vn | (mask ^ (d0 | vp))) << 1) | 1
    return d0, (((d0 & vp) << 1) | (mask ^ (d0 | (hp & mask)))) & mask, hp & d0


def distance(reference: str, hypothesis: str) -> int:
    """Levenshtein distance of whole texts; what they share at either end costs nothing."""
    a, b = (reference, hypothesis) if len(reference) >= len(hypothesis) else (hypothesis, reference)
    if (met := _met(a, b)) is not None:
        return sum(met)
    lo = _shared(a, b)
    a, b = a[lo:], b[lo:]
    hi = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not b:
        return len(a)
    places = _places(a)
    # a band around the diagonal, as wide as a lower bound of the distance lets hope and twice as wide each time it was not enough
    most = max(len(a) - len(b), (Counter(a) - Counter(b)).total()) * 9 // 8 + 8
    while 4 * most < len(a):
        if (found := _within(a, b, places, most)) is not None:
            return found
        most *= 2
    mask = (1 << len(a)) - 1
    vp, vn = mask, 0
    for c in b:
        _, vp, vn = _column(places.get(c, 0), vp, vn, mask)
    return len(b) + vp.bit_count() - vn.bit_count()


def _within(a: str, b: str, places: dict[str, int], most: int, block: int = 1024) -> int | None:
    """The distance if it is at most ``most``, else None; ``a`` is not the shorter text, nor shorter than it by more.

    The bit vectors hold the 2 * most + 1 diagonals of a band and slide down one row a column (Hyyrö). The score
    is followed along the band's lower edge, then along the last row.
    """
    wide = 2 * most + 1
    mask, edge = (1 << wide) - 1, 1 << (wide - 1)
    vp, vn, score, corner, last = mask ^ ((1 << most) - 1), 0, most, len(a) - most, edge >> 1
    for first in range(0, len(b), block):
        # the rows that this block of columns meets, bit 0 the band's first row in its first column
        top, part = first - most, (1 << (wide + block)) - 1
        rows = {c: (x >> top if top >= 0 else x << -top) & part for c, x in places.items()}
        for k, c in enumerate(b[first : first + block]):
            eq = (rows.get(c, 0) >> k) & mask
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
            hp, hn = vn | (mask ^ (d0 | vp)), d0 & vp
            if first + k < corner:
                score += not d0 & edge
            else:
                score += bool(hp & last) - bool(hn & last)
                last >>= 1
            if score > 2 * most:
                return None  # no way back: the rest of the last row can mend one edit a column of the band at most
            down = d0 >> 1
            vp, vn = hn | (mask ^ (down | hp)), down & hp
    return score if score <= most else None


def _long_split(a: str, b: str) -> tuple[int, int, int]:
    """The split of one pair by a backtrace; columns are kept for one block at a time and made again from its left edge."""
    mask, places, step = (1 << len(a)) - 1, _places(a), isqrt(len(b)) + 1
    vp, vn, edges = mask, 0, []
    for j, c in enumerate(b):
        if j % step == 0:
            edges.append((vp, vn))
        _, vp, vn = _column(places.get(c, 0), vp, vn, mask)
    i, j, s, d = len(a), len(b), 0, 0
    while i and j:
        first = (j - 1) // step * step
        (vp, vn), kept = edges[first // step], []
        for c in b[first:j]:
            d0, vp, vn = _column(places.get(c, 0), vp, vn, mask)
            kept.append((d0, vp))
        while i and j > first:
            same, rise = kept[j - 1 - first]
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            elif not same >> (i - 1) & 1:
                s, i, j = s + 1, i - 1, j - 1
            elif rise >> (i - 1) & 1:
                d, i = d + 1, i - 1
            else:
                j -= 1
    d += i
    return s, d, len(b) - len(a) + d


@F.pandas_udf(T.IntegerType())
def _distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for r, h in batches:
        yield pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(r, h, strict=True)], dtype="Int32")


def edit_distance(reference: Column, hypothesis: Column) -> Column:
    """As the built-in levenshtein, for texts of any length."""
    return _distance(reference, hypothesis)


@F.pandas_udf(SPLIT)
def _split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for r, h in batches:
        rows = split_many([x or "" for x in r], [y or "" for y in h])
        yield pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"])


def edit_split(reference: Column, hypothesis: Column) -> Column:
    return _split(reference, hypothesis)


def _edits(references: list[str | None], hypotheses: list[str | None], split: bool) -> Iterator[tuple]:
    """Lengths, edits and, with ``split``, substitutions, deletions and insertions of many pairs; what is null splits as if empty."""
    size = lambda t: None if t is None else len(t)
    parts = split_many([r or "" for r in references], [h or "" for h in hypotheses]) if split else [()] * len(references)
    for r, h, s in zip(references, hypotheses, parts, strict=True):
        yield size(r), size(h), None if r is None or h is None else sum(s) if split else distance(r, h), *s


def edit_facts(reference: Column, hypothesis: Column, split: bool = False, compose: bool = True) -> Column:
    """Of both texts in evaluation form, as they are (strict) and without white space (bare): lengths, edits and, with ``split``, S, D and I.

    Forms, distances and splits are made in one pass, so that a text goes to Python once.
    """
    names = ["reference_characters", "hypothesis_characters", "edits", *(SPLIT.names if split else [])]

    @F.arrow_udf(T.StructType([T.StructField(k, T.StructType(_INTS(*names))) for k in ("strict", "bare")]))
    def facts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([pa.field(k, pa.struct([pa.field(n, pa.int32()) for n in names])) for k in ("strict", "bare")])
        last, known = None, (None, None)
        for r, h in batches:
            for first in range(0, max(len(r), 1), PIECE):
                forms: list[tuple[list, list]] = [([], []), ([], [])]
                for x, y in zip(r.slice(first, PIECE).to_pylist(), h.slice(first, PIECE).to_pylist(), strict=True):
                    if x != last:  # a reference's pairs follow each other after a join
                        last, known = x, evaluation_forms(x, compose)
                    for (one, two), u, v in zip(forms, known, evaluation_forms(y, compose), strict=True):
                        one.append(u)
                        two.append(v)
                rows = [[dict(zip(names, x, strict=True)) for x in _edits(one, two, split)] for one, two in forms]
                yield pa.array([{"strict": x, "bare": y} for x, y in zip(*rows, strict=True)], kind)

    return facts(reference, hypothesis)


def rate(edits: Column, reference_chars: Column, hypothesis_chars: Column) -> Column:
    """Character error rate; without a reference 0 if nothing was read, else infinite."""
    lone = F.when(hypothesis_chars == 0, 0.0).otherwise(F.lit(float("inf")))
    return F.when(reference_chars == 0, lone).otherwise(edits.cast("double") / reference_chars)


def accuracy(cer: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - cer)


class _Gestalt(SequenceMatcher):
    """The library's matcher without junk, with the same blocks.

    Texts of one length whose differences lie at characters that only the first has, common beginnings, and texts that lost one
    character in places are matched in about linear time. Else all common blocks of a size are found at once by hashes of windows, then longest matches of what lies between
    them, in large ranges by hashes too. Blocks found by hashes are checked on the text.
    """

    def __init__(self, a: str, b: str, cells: int = 1 << 14):
        super().__init__(None, "", "", autojunk=False)
        self.a, self.b, self.cells = a, b, cells  # without the library's index of b, which nothing here asks

    @cached_property
    def down(self) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(max(len(self.a), len(self.b)) + 1, pow(_BASE, -1, 1 << 64), np.uint64)])

    @cached_property
    def sums(self) -> list[np.ndarray]:
        up = np.cumprod(np.r_[np.uint64(1), np.full(max(len(self.a), len(self.b)) + 1, _BASE, np.uint64)])
        out = []
        for t in (self.a, self.b):
            c = _codes(t).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            c = (c ^ (c >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            out.append(np.r_[np.uint64(0), np.cumsum(c * up[: len(c)], dtype=np.uint64)])
        return out

    def get_matching_blocks(self):
        if self.matching_blocks is None:
            self.matching_blocks = [Match(*x) for x in zip(*(c.tolist() for c in self.blocks()), strict=True)]
        return self.matching_blocks

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts in both texts and sizes of the blocks in order, neighbours joined, with the library's empty one at the end."""
        n, m = len(self.a), len(self.b)
        found = self._at_marks()
        if found is None:
            p = self._start()
            found = None if p else self._at_losses()
            if found is None:
                rows = ([(0, 0, p)] if p else []) + self._between(p, n, p, m)
                found = np.array(sorted(rows), np.int64).reshape(-1, 3).T
        i, j, k = found
        if len(i):
            new = np.r_[True, (i[:-1] + k[:-1] != i[1:]) | (j[:-1] + k[:-1] != j[1:])]
            i, j, k = i[new], j[new], np.add.reduceat(k, np.flatnonzero(new))
        return np.r_[i, n], np.r_[j, m], np.r_[k, 0]

    def _at_marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Blocks of texts of one length that agree but where the first has characters that the second has nowhere.

        No block holds such a mark, so the longest is the first longest run between marks, at its own place in the second
        text if it comes there no earlier: it can only where it holds a character that stands at a mark there.
        """
        n = len(self.a)
        if n != len(self.b) or not n:
            return None
        x, y = _codes(self.a), _codes(self.b)
        same = x == y
        lost, put = set(x[~same].tolist()), set(y[~same].tolist())
        if any(chr(c) in self.b for c in lost):
            return None
        edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
        i, to = edge[::2], edge[1::2]
        if held := [c for c in put if chr(c) in self.a]:
            at = np.flatnonzero(np.isin(x, np.array(held, np.uint32)))
            for r in np.unique(np.searchsorted(i, at, "right") - 1).tolist():
                if r >= 0 and (own := self.a[i[r] : to[r]]) and self.b.find(own) != i[r]:
                    return None
        return i, i, to - i

    def _start(self) -> int:
        """Length of a common beginning that is the longest match, else 0.

        A longer one would lie askew, less than the rest behind it, so that the beginning would repeat itself by so much.
        """
        p = _shared(self.a, self.b)
        rest = max(len(self.a), len(self.b)) - p
        wide = min(64, p - 2 * rest)
        return p if wide > 0 and self.a.find(self.a[rest : rest + wide], rest + 1, 2 * rest + wide) < 0 else 0

    def _at_losses(self, pairs: int = 1 << 18) -> np.ndarray | None:
        """Blocks where the second text is the first without some of one character, one in a place at most; else None.

        The runs between lost characters are the blocks unless a common block that is no run is as long as the longest run of a
        range. Such a block lies in a run and the lost character behind it (then it is the run at an earlier place, or the
        run and the character), is a lost character, or holds one with its next character, and so stands where the second
        text has those two. The range of runs no longer than such a block is matched anew.
        """
        a, b, n, m = self.a, self.b, len(self.a), len(self.b)
        if not 0 < m < n:
            return None
        x, y = _codes(a), _codes(b)
        if max(x.max(), y.max()) >= 0xFFF0:
            both = np.unique(np.r_[x, y], return_inverse=True)[1]
            if both.max() >= 0xFFF0:
                return None
            x, y = both[:n], both[n:]
        size = int(max(x.max(), y.max())) + 1
        more = np.bincount(x, minlength=size) - np.bincount(y, minlength=size)
        kinds = np.flatnonzero(more)
        if len(kinds) != 1:
            return None
        lost = int(kinds[0])
        at, to = np.flatnonzero(x != lost), np.flatnonzero(y != lost)
        if not (x[at] == y[to]).all():
            return None
        held = np.diff(to, prepend=-1, append=m) - 1
        gone = np.diff(at, prepend=-1, append=n) - 1 - held
        if gone.min() < 0 or gone.max() > 1:
            return None
        # where one is lost of several, the longer of the two runs has the others
        e = np.flatnonzero(gone)
        held, at, to = held[e], np.append(at, -1)[e - 1] + 1, np.append(to, -1)[e - 1] + 1
        i, j, end = np.append(0, at + held + 1), np.append(0, to + held), np.append(at, n)
        wide = end - i + np.append(0, held) + np.append(held, 0)
        left = wide[:-1] >= wide[1:]
        i[1:] -= held * ~left
        j[1:] -= held * ~left
        end[:-1] += held * left
        k = end - i
        needs = y[np.flatnonzero(y[:-1] == lost) + 1]
        if len(e) * int(np.isin(needs, x[i[1:][k[1:] > 0]]).sum()) > 64 * (n + m):
            return None
        starts, froms, sizes = i.tolist(), j.tolist(), k.tolist()
        count = len(sizes)
        # nearest longer runs on both sides, and the nearest before that is as long
        before, same, after, stack = [-1] * count, [-1] * count, [count] * count, []
        for q, w in enumerate(sizes):
            while stack and sizes[stack[-1]] < w:
                after[stack.pop()] = q
            if stack:
                same[q] = u = stack[-1]
                before[q] = before[u] if sizes[u] == w else u
            stack.append(q)

        # index -1 and count stand for the ends
        tops, ends, froms = [*sizes, n + 1], [*(j + k).tolist(), 0], [*froms, m]

        def around(q, most):
            u, v = before[q], after[q]
            while tops[u] <= most:
                u = before[u]
            while tops[v] <= most:
                v = after[v]
            return u, v

        anew, tried, mark, last = set(), set(), a[end[0]], count - 1
        for q, w in enumerate(sizes):
            p, u = froms[q], same[q]
            run = a[starts[q] : starts[q] + w]
            if u < q - 1 and w and b.find(run, ends[u], p + w - 1) >= 0:
                anew.add(around(q, w))
            if q < last:
                u, v = around(q, w + 1)
                if v - u > 2 and (run, u) not in tried:
                    tried.add((run, u))
                    if b.find(run + mark, ends[u], froms[v]) >= 0:
                        anew.add((u, v))
            if w <= 1 and q:
                u, v = around(q, 1)
                if b.find(mark, ends[u], froms[v]) >= 0:
                    anew.add((u, v))
        for q, w in self._across(x, y, lost, i, j, k, pairs):
            anew.add(around(q, w))
        rows, done, kept = [], 0, k > 0
        for u, v in sorted(anew, key=lambda r: (r[0], -r[1])):
            if u + 1 >= done:  # not within the last
                rows += self._between(starts[u] + sizes[u] if u >= 0 else 0, starts[v] if v < count else n, ends[u], froms[v])
                kept[u + 1 : v], done = False, v
        found = np.stack([i, j, k])[:, kept]
        if not rows:
            return found
        found = np.concatenate([found, np.array(rows, np.int64).T], 1)
        return found[:, np.argsort(found[0])]

    def _across(self, x, y, lost, i, j, k, pairs) -> Iterator[tuple[int, int]]:
        """Common blocks over a lost character and its next that are as long as the runs they touch: a run's number, their size."""
        wide, packed = 8, []
        for t, filler in ((x, 0xFFFE), (y, 0xFFFD)):
            c = np.full(len(t) + 4 * wide, filler, np.uint64)
            c[2 * wide : -2 * wide] = t
            two = c[:-1] | c[1:] << np.uint64(16)
            packed.append((c, two[:-2] | two[2:] << np.uint64(32)))
        (one, a4), (two, b4) = packed
        q = np.flatnonzero(k[1:] > 0) + 1
        ys = np.flatnonzero(y[:-1] == lost)
        near = np.repeat(k, k)
        near = np.maximum(near[ys], near[ys + 1])
        follows, needs, ahead, back = x[i[q]], y[ys + 1], np.arange(wide), None
        for c in np.unique(follows).tolist():
            gaps, others = q[follows == c], np.flatnonzero(needs == c)
            step = max(1, pairs // len(gaps))
            for first in range(0, len(others), step):
                part = others[first : first + step]
                u, v = i[gaps] - 1 + 2 * wide, ys[part] + 2 * wide
                # where neither four characters before agree nor four behind, a block has 8 at most
                may = (a4[u + 2][:, None] == b4[v + 2]) | (a4[u - 4][:, None] == b4[v - 4]) | ((k[gaps] <= 8)[:, None] & (near[part] <= 8))
                g, h = np.nonzero(may)
                u, v, most = u[g], v[h], np.maximum(k[gaps[g]], near[part[h]])
                behind = one[u[:, None] + 2 + ahead] != two[v[:, None] + 2 + ahead]
                before = one[u[:, None] - 1 - ahead] != two[v[:, None] - 1 - ahead]
                short = behind.any(1) & before.any(1)
                w = 2 + behind.argmax(1) + before.argmax(1)
                for z in np.flatnonzero(short & (w >= most)).tolist():
                    yield int(gaps[g[z]]), int(w[z])
                w = 2 + np.where(behind.any(1), behind.argmax(1), len(y)) + np.where(before.any(1), before.argmax(1), len(y))
                for z in np.flatnonzero(~short & (w >= most)).tolist():
                    back = back or (self.a[::-1], self.b[::-1])
                    s, t = int(u[z]) - 2 * wide, int(v[z]) - 2 * wide
                    size = _shared(self.a, self.b, s, t, 16) + _shared(*back, len(x) - s, len(y) - t, 16)
                    if size >= most[z]:
                        yield int(gaps[g[z]]), size

    def _plain(self, alo, ahi, blo, bhi):
        """Blocks of a range as the library finds them, one longest match after the other."""
        out, todo = [], [(alo, ahi, blo, bhi)]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            if alo < ahi and blo < bhi:
                i, j, k = self.find_longest_match(alo, ahi, blo, bhi)
                if k:
                    out.append((i, j, k))
                    todo += [(alo, i, blo, j), (i + k, ahi, j + k, bhi)]
        return out

    def _between(self, alo, ahi, blo, bhi, size: int = 8):
        """Blocks of a range, from all common ones of ``size`` or more: the longest is taken and the others cut to what is left."""
        if (ahi - alo) * (bhi - blo) <= self.cells or (all_ := self._common(alo, ahi, blo, bhi, size)) is None:
            return self._plain(alo, ahi, blo, bhi)
        out, todo = [], [(alo, ahi, blo, bhi, *all_)]
        while todo:
            alo, ahi, blo, bhi, i, j, k = todo.pop()
            if alo >= ahi or blo >= bhi:
                continue
            cut = np.maximum(np.maximum(alo - i, blo - j), 0)
            k = np.minimum(np.minimum(ahi - i, bhi - j), k) - cut
            keep = k >= size
            i, j, k = (i + cut)[keep], (j + cut)[keep], k[keep]
            if not len(i):
                out += self._plain(alo, ahi, blo, bhi)
            elif len(i) == 1 or ((i[1:] >= i[:-1] + k[:-1]) & (j[1:] >= j[:-1] + k[:-1])).all():
                # none is in another's way
                for u, v, w in zip(i.tolist(), j.tolist(), k.tolist(), strict=True):
                    out.append((u, v, w))
                    if alo < u and blo < v:
                        out += self._plain(alo, u, blo, v)
                    alo, blo = u + w, v + w
                if alo < ahi and blo < bhi:
                    out += self._plain(alo, ahi, blo, bhi)
            else:
                top = np.flatnonzero(k == k.max())
                best = top[np.lexsort((j[top], i[top]))[0]] if len(top) > 1 else top[0]
                u, v, w = int(i[best]), int(j[best]), int(k[best])
                out.append((u, v, w))
                left, right = (i < u) & (j < v), (i + k > u + w) & (j + k > v + w)
                todo += [(alo, u, blo, v, i[left], j[left], k[left]), (u + w, ahi, v + w, bhi, i[right], j[right], k[right])]
        if any(self.a[i : i + k] != self.b[j : j + k] for i, j, k in out):
            return self._plain(alo, ahi, blo, bhi)
        return out

    def _common(self, alo, ahi, blo, bhi, size):
        """All common blocks of at least ``size`` that cannot be longer, in order; None if they are too many."""
        if min(ahi - alo, bhi - blo) < size:
            return None
        one, two = self._windows(0, alo, ahi, size), self._windows(1, blo, bhi, size)
        by_one, by_two = np.argsort(one), np.argsort(two)
        one, two = one[by_one], two[by_two]
        lo = np.searchsorted(two, one)
        n = np.searchsorted(two, one, "right") - lo
        total = int(n.sum())
        if total > 8 * (len(one) + len(two)):
            return None
        i = np.repeat(by_one, n)
        j = by_two[np.arange(total) + np.repeat(lo - np.cumsum(n) + n, n)]
        wide = len(one) + len(two)
        d, i = np.divmod(np.sort((i - j + len(two)) * wide + i), wide)
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)][:total])
        k = np.diff(np.r_[new, total]) + size - 1
        i, d = i[new], d[new] - len(two)
        order = np.argsort(i, kind="stable")
        return (i + alo)[order], (i - d + blo)[order], k[order]

    def _windows(self, k: int, lo: int, hi: int, size: int) -> np.ndarray:
        s = self.sums[k]
        return (s[lo + size : hi + 1] - s[lo : hi - size + 1]) * self.down[lo : hi - size + 1]

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if (ahi - alo) * (bhi - blo) <= self.cells:
            return self._short(alo, ahi, blo, bhi)
        both = lambda size: np.isin(self._windows(0, alo, ahi, size), self._windows(1, blo, bhi, size), kind="sort")
        size, over, most = 0, 1, min(ahi - alo, bhi - blo)
        while over <= most and both(over).any():
            size, over = over, 2 * over
        over = min(over, most + 1)
        while over - size > 1:
            mid = (size + over) // 2
            size, over = (mid, over) if both(mid).any() else (size, mid)
        if not size:
            return Match(alo, blo, 0)
        i = int(both(size).argmax())
        j = blo + int((self._windows(1, blo, bhi, size) == self._windows(0, alo, ahi, size)[i]).argmax())
        i += alo
        return Match(i, j, size) if self.a[i : i + size] == self.b[j : j + size] else self._short(alo, ahi, blo, bhi)

    def _short(self, alo, ahi, blo, bhi):
        if (ahi - alo == 1 or bhi - blo == 1) and ahi - alo + bhi - blo < 64:  # one character: its first place
            for i in range(alo, ahi):
                if (j := self.b.find(self.a[i], blo, bhi)) >= 0:
                    return Match(i, j, 1)
            return Match(alo, blo, 0)
        places: dict[str, list[int]] = {}
        for j in range(blo, bhi):
            places.setdefault(self.b[j], []).append(j)
        best, runs = (alo, blo, 0), {}
        for i in range(alo, ahi):
            now = {}
            for j in places.get(self.a[i], ()):
                k = now[j] = runs.get(j - 1, 0) + 1
                if k > best[2]:
                    best = (i - k + 1, j - k + 1, k)
            runs = now
        return Match(*best)


_TAGS = ("replace", "delete", "insert", "equal")


def _ops(a: str, b: str) -> np.ndarray:
    """Opcodes as rows: tag's number, i1, i2, j1, j2; each block with what lies before it."""
    i, j, k = _Gestalt(a, b).blocks()
    u, v = np.r_[0, (i + k)[:-1]], np.r_[0, (j + k)[:-1]]
    gap = np.where((u < i) & (v < j), 0, np.where(u < i, 1, 2))
    both = np.stack([gap, u, i, v, j], 1), np.stack([np.full(len(k), 3), i, i + k, j, j + k], 1)
    some = np.stack([(u < i) | (v < j), k > 0], 1)
    return np.stack(both, 1)[some]


@F.arrow_udf(OPCODES)
def _opcodes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for r, h in batches:
        for first in range(0, max(len(r), 1), PIECE):
            found = [_ops(x or "", y or "") for x, y in zip(r.slice(first, PIECE).to_pylist(), h.slice(first, PIECE).to_pylist(), strict=True)]
            rows = np.concatenate([*found, np.empty((0, 5), np.int64)]).astype(np.int32)
            parts = [pa.array(_TAGS).take(pa.array(rows[:, 0])), *(pa.array(rows[:, k].copy()) for k in range(1, 5))]
            yield pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.StructArray.from_arrays(parts, ["tag", "i1", "i2", "j1", "j2"]))


def opcodes(reference: Column, hypothesis: Column) -> Column:
    """Gestalt opcodes, popular characters included; another alignment than the edit split's."""
    return _opcodes(reference, hypothesis)


ERRORS = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("tag", "g", "r", "c")], T.StructField("right", T.BooleanType())]))


_ERROR = ("ord", "tag", "g", "r", "c", "right")


def errors_of(reference: str, raw: str, corrected: str) -> list[dict]:
    """What ``raw`` lost or changed of the reference, beside the corrected text there, then what the corrected text put in.

    Opcodes of both are read side by side: equal runs are cut to the span, replaced runs come whole, and a span is right
    where only equal runs overlap it. Text put in by both alike is no error of the correction.
    """
    return [dict(zip(_ERROR, x, strict=True)) for x in zip(*_error_columns(reference, raw, corrected), strict=True)]


def _error_columns(reference: str, raw: str, corrected: str) -> tuple[list, ...]:
    same = np.array([(3, 0, len(reference), 0, len(reference))])
    ro, co = (same if t == reference else _ops(reference, t) for t in (raw, corrected))
    if ro is same is co:
        return tuple([] for _ in _ERROR)
    spans = ro[ro[:, 0] < 2]
    out = ords, tags, g, r, c, right = list(range(len(spans))), [_TAGS[t] for t in spans[:, 0].tolist()], [], [], [], [True] * len(spans)
    first = np.searchsorted(co[:, 2], spans[:, 1], "right")
    over = co[first]
    # most spans lie in one equal run of the corrected text
    whole = ((over[:, 0] == 3) & (over[:, 2] >= spans[:, 2])).tolist()
    for n, (i1, i2, j1, j2, to) in enumerate(zip(*spans[:, 1:].T.tolist(), (over[:, 3] - over[:, 1]).tolist(), strict=True)):
        g.append(reference[i1:i2])
        r.append(raw[j1:j2])
        if whole[n]:
            c.append(corrected[i1 + to : i2 + to])
            continue
        said = []
        for t, a, b, x, y in map(np.ndarray.tolist, co[first[n] :]):
            if a >= i2:
                break
            if t == 3:
                said.append(corrected[x + max(a, i1) - a : x + min(b, i2) - a])
            elif a < b:
                right[n] = False
                said.append(corrected[x:y])
        c.append("".join(said))
    had = {i1: raw[j1:j2] for _, i1, _, j1, j2 in ro[ro[:, 0] == 2].tolist()}
    for n, (_, i1, _, j1, j2) in enumerate(co[co[:, 0] == 2].tolist()):
        if corrected[j1:j2] != had.get(i1, ""):
            for column, x in zip(out, (1_000_000_000 + n, "insert", "", had.get(i1, ""), corrected[j1:j2], False), strict=True):
                column.append(x)
    return out


@F.arrow_udf(ERRORS)
def _errors(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kinds = (pa.int32(), *[pa.string()] * 4, pa.bool_())
    for texts in batches:
        for first in range(0, max(len(texts[0]), 1), PIECE):
            ends, columns = [0], [[] for _ in _ERROR]
            for x in zip(*(t.slice(first, PIECE).to_pylist() for t in texts), strict=True):
                bare = {t: evaluation_forms(t or "")[1] for t in {*x}}
                for column, more in zip(columns, _error_columns(*map(bare.get, x)), strict=True):
                    column += more
                ends.append(len(columns[0]))
            parts = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, list(_ERROR)))


def error_spans(reference: Column, raw: Column, corrected: Column) -> Column:
    """``errors_of`` texts without their white space; null is empty."""
    return _errors(reference, raw, corrected)


@F.pandas_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(first: Column, second: Column) -> Column:
    """Gestalt ratio with the matcher's own junk rule; not symmetric."""
    return _ratio(first, second)


def aligned_segment(ops: Column, hypothesis: Column, start: Column, end: Column) -> Column:
    """Hypothesis text beside reference[start:end]: equal runs are cut to the span, replaced runs come whole."""
    over = F.filter(ops, lambda o: (F.greatest(o["i1"], start) < F.least(o["i2"], end)) & o["tag"].isin("equal", "replace"))

    def text(o):
        a = F.when(o["tag"] == "equal", o["j1"] + F.greatest(o["i1"], start) - o["i1"]).otherwise(o["j1"])
        b = F.when(o["tag"] == "equal", o["j1"] + F.least(o["i2"], end) - o["i1"]).otherwise(o["j2"])
        return F.substring(hypothesis, a + 1, b - a)

    return F.array_join(F.transform(over, text), "")


def insertion_at(ops: Column, hypothesis: Column, position: Column) -> Column:
    """Text that the hypothesis inserts at one reference position, or ''."""
    hit = F.get(F.filter(ops, lambda o: (o["tag"] == "insert") & (o["i1"] == position)), F.lit(0))
    return F.coalesce(F.substring(hypothesis, hit["j1"] + 1, hit["j2"] - hit["j1"]), F.lit(""))


def span_correct(ops: Column, start: Column, end: Column) -> Column:
    """No opcode but equal ones overlaps reference[start:end]."""
    return ~F.exists(ops, lambda o: (o["tag"] != "equal") & (F.greatest(o["i1"], start) < F.least(o["i2"], end)))


def guarded(output: Column, source: Column, fallback: Column, low: float = 0.45, high: float = 1.60) -> Column:
    """Model output if it is not empty and its length stays within bounds of the source's, else the fallback."""
    ratio = F.length(output) / F.greatest(F.length(source), F.lit(1))
    return F.when((F.length(output) > 0) & ratio.between(low, high), output).otherwise(fallback)

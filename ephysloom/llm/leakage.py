"""Evaluation texts leaking into a corpus.

Search: every window of ``window`` words of a document is embedded by CGK
random walks (a walk copies the word under its pointer and advances by a random
bit of that word, so a small edit distance becomes a small Hamming distance);
each of ``repeats`` walks keeps a few sampled coordinates as a key, and equal
keys between document and item windows make a candidate.  Windows that share
fewer than ``least_shared`` words with the items' vocabulary are left out first.
It follows from the verification: a dense passage keeps at least ``COST / (1 +
COST)`` of its words, and a piece may be only ``least_piece`` words amid foreign
text; the smaller count is taken.  The search itself is by sampling; its recall
against alignment with every item is in the README.

Verification is exact: local word alignments of the whole document with the
whole item (edits cost more than matches earn, so that only dense passages
score), taken one after the other in every stretch of the document that some
alignment can reach, then the best chain of pieces that keeps the item's order.  ``found`` is decided on the number of matched words of that chain.

The items are a stated query set, small beside the corpus; they are taken in
blocks, each indexed on the driver and sent to the workers with the task.  The
corpus is read once per pass of several blocks, map-only: no shuffle, no state,
any skew.  Candidates are thinned before the alignment by bounds that lose no
match the alignment could count (see ``Leaks.stretches``).

Defined results: null and empty texts hold nothing; a text of any length is
searched whole; repeated documents are found under each id; repeated items under
each id; items shorter than a window are found when all their words match, and
never when they have fewer than ``least_words`` words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-­‐]\s*\n\s*(?:[>|#*]+\s*)?(?=[^\W\d_])")
_QUOTE = re.compile(r"(?m)^[ \t]*(?:>+[ \t]*)+")


def words(text: str | None) -> list[str]:
    """Words in reading order: compatibility forms folded, lower case, words
    broken at line ends joined, accents and punctuation dropped."""
    if not text:
        return []
    t = _QUOTE.sub("", text)
    t = _BREAK.sub("", t).replace("­", "")
    t = unicodedata.normalize("NFKD", t)
    if not t.isascii():
        t = "".join(c for c in t if not unicodedata.combining(c) and c not in "​‌‍﻿⁠")
    return _WORD.findall(t.lower())


#: What a word exchanged, added or dropped costs where a match earns 1.
COST = 1.25


class Vocabulary:
    """Item words by number; document words by their closest item word."""

    def __init__(self, texts: list[list[str]], memory: int = 400_000):
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.near: dict[str, int] = {}
        for w, i in self.ids.items():
            if len(w) >= 5:
                for k in range(len(w)):
                    self.near.setdefault(w[:k] + w[k + 1 :], i)
        self.memory = memory
        self.seen: dict[str, tuple[int, ...]] = {}

    def __len__(self) -> int:
        return len(self.ids)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def look(self, w: str) -> tuple[int, ...]:
        """The word's number; else that of an item word one letter away; else
        the two numbers of two item words run together; else 0."""
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            got = self.seen[w] = self._look(w)
        return got

    def _look(self, w: str) -> tuple[int, ...]:
        i = self.ids.get(w)
        if i:
            return (i,)
        if 4 <= len(w) <= 24:
            i = self.near.get(w)
            if i:
                return (i,)
            for k in range(len(w)):
                cut = w[:k] + w[k + 1 :]
                i = (self.ids.get(cut) if len(cut) >= 5 else None) or (self.near.get(cut) if len(w) >= 5 else None)
                if i:
                    return (i,)
        if 5 <= len(w) <= 40:
            for k in range(2, len(w) - 1):
                a, b = self.ids.get(w[:k]), self.ids.get(w[k:])
                if a and b:
                    return (a, b)
        return (0,)


class Leaks:
    """One block of items, indexed."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = 10, repeats: int = 8, samples: int = 6, least_shared: int | None = None, least_words: int = 16, least_piece: int = 5, seed: int = 7):
        if least_shared is None:
            least_shared = min(-int(-window * COST // (1 + COST)), least_piece)
        self.window, self.repeats, self.least_shared = window, repeats, least_shared
        self.least_words, self.least_piece = least_words, least_piece
        texts = [words(t) for _, t in items]
        self.item_ids = [i for i, _ in items]
        self.vocab = Vocabulary(texts)
        self.items = [np.array([self.vocab.ids[w] for w in t], dtype=np.int32) for t in texts]
        self.places = [places(x) for x in self.items]
        span = len(self.vocab) + 1
        self.counts = np.zeros((len(texts), span), np.int16)  # of each word in each item
        codes = [np.unique(x[:-1].astype(np.int64) * span + x[1:]) for x in self.items]
        self.pair_codes = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        self.pairs = np.zeros((len(texts), len(self.pair_codes) + 1), bool)  # neighbouring words of each item
        for n, x in enumerate(self.items):
            np.add.at(self.counts[n], x, 1)
            self.pairs[n, np.searchsorted(self.pair_codes, codes[n]) + 1] = True
        rng = np.random.default_rng(seed)
        self.steps = 2 * window + window // 2
        self.bits = rng.integers(0, 2, size=(repeats, self.steps, len(self.vocab) + 1), dtype=np.int8)
        # coordinates are drawn from the part every walk is still inside the window
        self.samples = [np.sort(rng.choice(self.steps - window // 2, size=samples, replace=False)) for _ in range(repeats)]
        self.mix = rng.integers(1, 2**62, size=(samples,), dtype=np.int64) | 1
        keys, owner = [], []
        for n, x in enumerate(self.items):
            starts = np.arange(max(1, len(x) - window + 1))
            padded = np.concatenate([x, np.zeros(window + self.steps, np.int32)])
            for r in range(repeats):
                keys.append(self._keys(padded, starts, r))
                owner.append(np.full(len(starts), n, np.int32))
        k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        o = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        both = np.unique(np.stack([k, o.astype(np.int64)], 1), axis=0)
        self.keys, self.first = np.unique(both[:, 0], return_index=True)
        self.last = np.append(self.first[1:], len(both))
        self.owner = both[:, 1].astype(np.int32)

    def _keys(self, ids: np.ndarray, starts: np.ndarray, r: int) -> np.ndarray:
        """Key of repeat ``r`` of the window at each start."""
        at, end = starts.copy(), starts + self.window
        key = np.full(len(starts), r * 0x9E3779B97F4A7C & 0x7FFFFFFF, np.int64)
        n, last = 0, self.samples[r][-1]
        bits = self.bits[r]
        for j in range(last + 1):
            sym = np.where(at < end, ids[np.minimum(at, len(ids) - 1)], 0)
            if j == self.samples[r][n]:
                key = (key ^ (sym.astype(np.int64) + 0x51)) * self.mix[n]
                key ^= (key >> 29) & 0x7FFFFFFFF
                n += 1
            at = at + bits[j][sym]
        return key

    def numbers(self, text: str | list[str] | None) -> np.ndarray:
        look = self.vocab.look
        out: list[int] = []
        for w in text if isinstance(text, list) else words(text):
            out.extend(look(w))
        return np.array(out, dtype=np.int32)

    def candidates(self, docs: list[np.ndarray]) -> list[set[int]]:
        """Per document the items some window of it may come from."""
        found: list[set[int]] = [set() for _ in docs]
        if not docs or not len(self.keys):
            return found
        w = self.window
        gap = np.zeros(w, np.int32)
        ids = np.concatenate([y for x in docs for y in (x, gap)] + [np.zeros(self.steps, np.int32)])
        whose = np.repeat(np.arange(len(docs)), [len(x) + w for x in docs])
        c = np.concatenate([[0], np.cumsum(ids > 0)])
        starts = np.nonzero(c[w : len(whose) + w] - c[: len(whose)] >= self.least_shared)[0]
        if not len(starts):
            return found
        for r in range(self.repeats):
            k = self._keys(ids, starts, r)
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            hit = np.nonzero(self.keys[at] == k)[0]
            for d, a in np.unique(np.stack([whose[starts[hit]], at[hit]], 1), axis=0):
                found[d].update(self.owner[self.first[a] : self.last[a]].tolist())
        return found

    def matched(self, doc: np.ndarray | list[np.ndarray], item: np.ndarray) -> int:
        """Words of the item matched in its order by dense pieces of the doc.

        The doc may be given as stretches that no piece crosses.  A stretch is
        searched in overlapping windows no piece is longer than the overlap of,
        so a stretch of any length takes the memory of one window.
        """
        runs = doc if isinstance(doc, list) else [doc]
        reach = int(len(item) * (1 + 1 / COST)) + 2
        pieces, offset = [], 0
        for run in runs:
            free, step = run.copy(), 4 * reach
            for at in range(0, max(1, len(run) - reach), step):
                part = free[at : at + step + reach]
                while True:
                    p = align(item, part)
                    if p is None or len(p) < self.least_piece:
                        break
                    pieces.append([(i, offset + at + j) for i, j in p])
                    part[p[0][1] : p[-1][1] + 1] = 0
            offset += len(run) + 1
        return chain(pieces)

    def stretches(self, doc: np.ndarray, cand: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
        """The stretches of the doc that pieces of each candidate can reach,
        for the candidates that can still have ``least_words`` words in them.

        Inside a piece the item's words outweigh the others, at least
        ``least_piece`` of them stand in it, and of ``m`` matches with fewer
        than ``m / COST`` edits some two stand together in both texts; with
        ``b`` such pairs a stretch holds at most ``9 b`` matches.
        """
        out: list[tuple[int, list[np.ndarray]]] = []
        k = np.bincount(doc, minlength=len(self.vocab) + 1)
        cand = cand[np.minimum(self.counts[cand], k)[:, 1:].sum(1) >= self.least_words]
        if not len(cand):
            return out
        n = len(doc)
        code = doc[:-1].astype(np.int64) * (len(self.vocab) + 1) + doc[1:]
        pid = np.minimum(np.searchsorted(self.pair_codes, code), max(0, len(self.pair_codes) - 1))
        pid = np.where(self.pair_codes[pid] == code, pid + 1, 0) if len(self.pair_codes) else np.zeros(n - 1, np.int64)
        group = max(1, 2_000_000 // (n + 1))
        for g in range(0, len(cand), group):
            some = cand[g : g + group]
            hit = self.counts[some][:, doc] > 0
            hit[:, doc == 0] = False
            two = np.zeros((len(some), n), bool)
            two[:, 1:] = self.pairs[some][:, pid]
            c = np.zeros((len(some), n + 1), np.float32 if n < 1_000_000 else np.float64)
            np.cumsum(np.where(hit, np.float32(1), np.float32(-COST)), axis=1, out=c[:, 1:])
            ahead = np.maximum.accumulate(c[:, :0:-1], axis=1)[:, ::-1]  # best sum ending at or after each word
            keep = np.zeros((len(some), n + 1), np.int8)
            keep[:, :n] = ahead - np.minimum.accumulate(c[:, :-1], axis=1) > 1e-3
            edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.ravel()])))
            a, b = edge[::2], edge[1::2]
            row, lo = np.divmod(a, n + 1)
            hi = lo + (b - a)
            h = np.concatenate([np.zeros((len(some), 1), np.int32), np.cumsum(hit, axis=1, dtype=np.int32)], 1)
            t = np.cumsum(two, axis=1, dtype=np.int32)
            hits, twos = h[row, hi] - h[row, lo], t[row, hi - 1] - t[row, lo]
            ok = (hits >= self.least_piece) & (twos >= 1)
            row, lo, hi, most = row[ok], lo[ok], hi[ok], np.minimum(hits, 9 * twos)[ok]
            total = np.bincount(row, most, minlength=len(some))
            for r in np.flatnonzero(total >= self.least_words).tolist():
                m = int(some[r])
                runs, bound = [], 0
                for x, y in zip(lo[row == r].tolist(), hi[row == r].tolist(), strict=True):
                    common = common_subsequence(doc[x:y], self.places[m], len(self.items[m]))
                    if common >= self.least_piece:
                        runs.append(doc[x:y])
                        bound += common
                if bound >= self.least_words:
                    out.append((m, runs))
        return out

    def promising(self, pairs: list[tuple[int, list[np.ndarray]]]) -> list[list[np.ndarray]]:
        """Of each (item, stretches) the stretches whose best alignment has at
        least ``least_piece`` matches, all alignments a row at a time together."""
        flat: list[tuple[int, int, np.ndarray]] = []  # owner, item, window
        for p, (m, runs) in enumerate(pairs):
            reach = int(len(self.items[m]) * (1 + 1 / COST)) + 2
            for q, run in enumerate(runs):
                for at in range(0, max(1, len(run) - reach), 4 * reach):
                    flat.append(((p, q), m, run[at : at + 5 * reach]))
        good: set[tuple[int, int]] = set()
        flat.sort(key=lambda x: (len(x[2]), len(self.items[x[1]])))
        at = 0
        while at < len(flat):
            end = at + 1
            while end < len(flat) and end - at < 400 and len(flat[end][2]) * (end - at + 1) <= 100_000:
                end += 1
            part = flat[at:end]
            most = most_matches([self.items[m] for _, m, _ in part], [x for _, _, x in part])
            good.update(o for (o, _, _), k in zip(part, most.tolist(), strict=True) if k >= self.least_piece)
            at = end
        kept = [[run for q, run in enumerate(runs) if (p, q) in good] for p, (_, runs) in enumerate(pairs)]
        common = lambda m, x: common_subsequence(x, self.places[m], len(self.items[m]))
        return [runs if sum(common(m, x) for x in runs) >= self.least_words else [] for (m, _), runs in zip(pairs, kept, strict=True)]

    def leaks(self, docs: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """Per document (item id, matched words) of the items it leaks."""
        out: list[list[tuple[int, int]]] = [[] for _ in docs]
        pairs, whose = [], []
        for d, (doc, cand) in enumerate(zip(docs, self.candidates(docs), strict=True)):
            some = np.array([n for n in sorted(cand) if len(self.items[n]) >= self.least_words], dtype=np.int64)
            if len(some) and len(doc) > 1:
                got = self.stretches(doc, some)
                pairs += got
                whose += [d] * len(got)
        for d, (m, _), runs in zip(whose, pairs, self.promising(pairs), strict=True):
            score = self.matched(runs, self.items[m]) if runs else 0
            if score >= self.least_words:
                out[d].append((self.item_ids[m], score))
        return out


def most_matches(items: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Matches of the best local alignment of each item with its doc.

    The score carries the matches as a small part below its grid of quarters.
    """
    width, height, tiny = max(map(len, docs)), max(map(len, items)), 2.0**-24
    d = np.zeros((len(docs), width), np.int32)
    for k, x in enumerate(docs):
        d[k, : len(x)] = x
    w = np.full((len(items), height), -1, np.int32)
    for k, x in enumerate(items):
        w[k, : len(x)] = x
    ramp = np.arange(width + 1) * COST
    h = np.zeros((len(docs), width + 1))
    best = np.zeros(len(docs))
    new = np.empty_like(h)
    for i in range(height):
        step = np.where(d == w[:, i, None], 1 + tiny, -COST)
        step += h[:, :-1]
        np.subtract(h, COST, out=new)
        np.maximum(new[:, 1:], step, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, axis=1, out=new)
        new -= ramp
        h, new = new, h
        np.maximum(best, h.max(1), out=best)
    return np.round(np.mod(best + tiny / 4, 0.25) / tiny).astype(int)


def places(item: np.ndarray) -> dict[int, int]:
    """Each word's positions in the item as the bits of a number."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(doc: np.ndarray, at: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, a row of the table at a time
    as the bits of one number."""
    v = (1 << n) - 1
    for w in doc[doc > 0].tolist():
        m = at.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return n - (v & ((1 << n) - 1)).bit_count()


def align(item: np.ndarray, doc: np.ndarray, cost: float = COST) -> list[tuple[int, int]] | None:
    """The best local alignment's matches (item position, doc position).

    A match earns 1, a word exchanged, added or dropped costs ``cost``.
    """
    n = len(doc)
    if not n or not len(item):
        return None
    ramp = np.arange(n + 1, dtype=np.float32) * cost
    h = np.zeros((len(item) + 1, n + 1), np.float32)
    for i, w in enumerate(item):
        row = np.maximum(h[i], 0)
        new = np.maximum(row - cost, 0)
        np.maximum(new[1:], row[:-1] + np.where(doc == w, np.float32(1), np.float32(-cost)), out=new[1:])
        h[i + 1] = np.maximum(np.maximum.accumulate(new + ramp) - ramp, 0)
    i, j = divmod(int(h.argmax()), n + 1)
    if h[i, j] <= 0:
        return None
    path: list[tuple[int, int]] = []
    while i and j and h[i, j] > 1e-3:
        same = doc[j - 1] == item[i - 1]
        if abs(h[i, j] - (h[i - 1, j - 1] + (1 if same else -cost))) < 1e-2:
            if same:
                path.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(h[i, j] - (h[i - 1, j] - cost)) < 1e-2:
            i -= 1
        else:
            j -= 1
    return path[::-1]


def chain(pieces: list[list[tuple[int, int]]]) -> int:
    """Most matched words of pieces that follow one another in both texts."""
    ps = sorted(pieces, key=lambda p: p[0][1])
    best: list[int] = []
    for n, p in enumerate(ps):
        b = len(p)
        for m in range(n):
            q = ps[m]
            if q[-1][1] < p[0][1]:
                over = sum(1 for i, _ in p if i <= q[-1][0])
                if over < len(p) and q[0][0] < p[0][0]:
                    b = max(b, best[m] + len(p) - over)
        best.append(b)
    return max(best, default=0)


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", block: int = 500, blocks_per_pass: int = 8, **params
) -> DataFrame:
    """``doc_id, item_id, matched_words`` of every document that leaks an item.

    ``block`` bounds the size of one index (its word and pair tables grow with
    the square of the block), ``blocks_per_pass`` the indexes a worker holds;
    the corpus is read once for every ``block * blocks_per_pass`` items.
    """
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).dropna().distinct()
    n_blocks = max(1, -(-rows.count() // block))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna()
    out = None
    for first in range(0, n_blocks, blocks_per_pass):
        parts = [rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b) for b in range(first, min(first + blocks_per_pass, n_blocks))]
        indexes = [Leaks([tuple(r) for r in part.orderBy("item_id", "item_text").collect()], **params) for part in parts]

        def search(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    ids, texts = piece.column("doc_id").to_pylist(), [words(t) for t in piece.column("text").to_pylist()]
                    rows = [(d, i, s) for index in indexes for d, got in zip(ids, index.leaks([index.numbers(t) for t in texts]), strict=True) for i, s in got]
                    if rows:
                        d, i, s = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int32())], names=["doc_id", "item_id", "matched_words"])

        found = src.mapInArrow(search, "doc_id long, item_id long, matched_words int")
        out = found if out is None else out.unionByName(found)
    return out

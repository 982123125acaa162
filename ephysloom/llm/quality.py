"""Per-document text quality: statistics, and prose against everything else.

``text_stats`` is one JVM-side projection.  ``label_shares`` labels every line
prose, list, table or junk with a hidden Markov model over discrete line
statistics and adds up the labels' characters per document.

The model is trained here: a table of word-order statistics (how much more often
one function word, content word or mark follows another than by chance), counted
over all lines of all documents, and the states' emission and transition
frequencies, counted over the lines of a bounded sample (``sample_docs``, chosen
by a hash of the id) that plain rules can label and smoothed towards those rules.  Labelling
then covers every document whole, map-only: no shuffle, so no skew.

Defined results: a null text has no row in ``label_shares``; an empty or blank
text has no lines, shares 0 and is not counted as non-prose; repeated documents
are labelled under each id; a single line of any length is one line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "list", "table", "junk")

# ------------------------------------------------------------- statistics


def text_stats(docs: DataFrame, common: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, mean_word_len, symbol_share, punct_line_share,
    common_share``; ratios over nothing are null, a null text has 0 words.

    Words are runs of letters; symbols are neither letter, digit nor space.
    ``common`` is the fixed list of frequent words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.regexp_extract_all(t, F.lit(r"(\p{L}+)"), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")
    ends = F.filter(lines, lambda x: x.rlike(r"[.!?…]\s*$"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    d = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), w.alias("w"), lines.alias("lines"), F.size(ends).alias("n_ends"))
    n = F.size("w")
    letters = F.length(F.regexp_replace("t", r"\P{L}", ""))
    symbols = F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", ""))
    hits = F.size(F.filter("w", lambda x: F.lower(x).isin(common))) if common else F.lit(0)
    return d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        ratio(letters, n).alias("mean_word_len"),
        ratio(symbols, F.length("t")).alias("symbol_share"),
        ratio(F.col("n_ends"), F.size("lines")).alias("punct_line_share"),
        ratio(hits, n).alias("common_share"),
    )


# ---------------------------------------------------------- line features

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[.,;:!?]")
_BULLET = re.compile(r"^\s*(?:[-*•–—·+◦▪]|\[[ xX]?\])\s+\S")
_NUMBERED = re.compile(r"^\s*(?:\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,4}[.)])\s+\S")
_STAMP = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d{1,2}:\d\d(?::\d\d)?|[0-9a-f]{8}\s|0x[0-9a-f]+)")
_KEYED = re.compile(r"^\s*[\w .-]{1,24}[:=]\s*\S{0,24}\s*$")
_CODE = re.compile(r"[{}\[\]()=<>]|^\s{4,}|\w\.\w+\(|_\w|0x[0-9a-f]|\\|^\s*#include|;\s*$")
_QUOTED = re.compile(r"^\s*(?:>+\s*)+")
_MARK = re.compile(r"^\s*(?:[-*•–—·+◦▪]|\[[ xX]?\]|\(?\w{1,3}[.)])\s+")
_SEP = re.compile(r"[,;]+")
_HEAD = re.compile(r"^\s*(?:#{1,6}|={2,})\s+\S")
_PLAIN = re.compile(r"[a-zA-Z0-9\s.,;:!?'\"()\[\]{}<>=+*/\\|_#%&@$^~`-]|[^\W_]|[’‘“”«»„…–—•·°§€µ]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\[\]{}<>=+*/\\|#%&@$^~`’‘“”«»„…–—•·°-]")
_VOWEL = re.compile(r"[aeiouyäöüàâéèêëîïôùûœæ]", re.I)

#: A line whose mean log ratio and summed log ratio are below these is no prose,
#: whatever else it shows.
UNLIKE, CERTAIN = -0.15, -12.0

SHAPES = ("plain", "bullet", "numbered", "pipe", "tab", "delimited", "columns", "keyed", "stamp", "code", "heading")
SIZES = {"shape": len(SHAPES), "words": 6, "common": 6, "letters": 5, "end": 7, "order": 5, "odd": 6, "commas": 3, "place": 3}


def _bin(x: float, edges: tuple[float, ...]) -> int:
    n = 0
    for e in edges:
        if x >= e:
            n += 1
    return n


class Order:
    """Word-order statistics: mean log ratio of a pair's frequency to chance.

    Chance is taken per language (of ``common``, the function words by
    language), else any two words of one language would seem to attract.
    """

    def __init__(self, common: dict[str, set[str]], pairs: dict[tuple[str, str, str], int] | None = None, smooth: float = 4.0):
        self.common = common
        self.table: dict[str, dict[tuple[str, str], float]] = {lang: {} for lang in common}
        for lang in common if pairs else ():
            own = {(a, b): n for (g, a, b), n in pairs.items() if g == lang}
            left, right, total = Counter(), Counter(), sum(own.values())
            for (a, b), n in own.items():
                left[a] += n
                right[b] += n
            for a, na in left.items():
                for b, nb in right.items():
                    by_chance = na * nb / total
                    self.table[lang][a, b] = float(np.log((own.get((a, b), 0) + smooth) / (by_chance + smooth)))

    def classes(self, line: str) -> tuple[str, list[str]]:
        """(language with the most function words, classes of the tokens)."""
        tokens = _TOKEN.findall(line.lower())
        lang, most = "", -1
        for g, words in self.common.items():
            n = sum(1 for t in tokens if t in words)
            if n > most:
                lang, most = g, n
        known = self.common.get(lang, ())
        out = []
        for t in tokens:
            if t in known:
                out.append(t)
            elif t[0].isdigit():
                out.append("0")
            elif t[0] in ".,;:!?":
                out.append("." if t in ".!?" else ",")
            else:
                out.append("w")
        return lang, out

    def score(self, lang: str, classes: list[str]) -> float | None:
        if len(classes) < 7:
            return None
        get = self.table.get(lang, {}).get
        return sum(get(p, 0.0) for p in zip(classes, classes[1:], strict=False)) / (len(classes) - 1)


def line_symbols(lines: list[str], order: Order) -> np.ndarray:
    """Discrete statistics of each line, one column per entry of SIZES."""
    out = np.zeros((len(lines), len(SIZES)), np.int8)
    before: str | None = None
    for n, raw in enumerate(lines):
        s = _QUOTED.sub("", raw)
        body = s.strip()
        lang, classes = order.classes(s)
        words = [c for c in classes if c not in (".", ",", "0")]
        nw = len(words)
        ink = len(body) - body.count(" ") or 1
        letters = sum(map(str.isalpha, body)) / ink
        commas = body.count(",") + body.count(";")
        entry_words = 99.0
        if commas >= 2:  # words per enumerated entry, its own bullet aside
            entries = [_MARK.sub("", x).split() for x in _SEP.split(body)]
            entries = [x for x in entries if x]
            entry_words = sum(map(len, entries)) / max(1, len(entries))
        tokens = body.split()
        longest = max(map(len, tokens), default=0)
        digits = sum(map(str.isdigit, body))
        if _HEAD.match(s):
            shape = 10
        elif _BULLET.match(s):
            shape = 1
        elif _NUMBERED.match(s):
            shape = 2
        elif body.count("|") >= 2:
            shape = 3
        elif "\t" in body:
            shape = 4
        elif commas >= 2 and len(tokens) <= commas and (body.count(",") == commas or body.count(";") == commas) and ", " not in body and "; " not in body:
            shape = 5
        elif _STAMP.match(s):
            shape = 8
        elif re.search(r"\S {2,}\S.* {2,}\S", body) or (re.search(r"\S {3,}\S", body) and digits):
            shape = 6
        elif _KEYED.match(s):
            shape = 7
        elif _CODE.search(s) and len(_CODE.findall(s)) * 12 > len(tokens) * 3:
            shape = 9
        else:
            shape = 0
        score = order.score(lang, classes)
        odd_chars = len(_ODD.findall(body))
        if odd_chars > 0.12 * len(body):
            odd = 4
        elif longest > 32 and longest > 0.5 * len(body):
            odd = 3
        elif len(tokens) >= 3 and len(set(tokens)) <= 0.34 * len(tokens):
            odd = 1
        elif before == body and body:
            odd = 2
        elif nw >= 3 and sum(1 for t in tokens if t.isalpha() and len(t) > 3 and not _VOWEL.search(t)) > 0.4 * len(tokens):
            odd = 5
        else:
            odd = 0
        last = body[-1:] or " "
        common = sum(1 for c in words if c != "w")
        out[n] = (
            shape,
            _bin(nw, (1, 2, 4, 6, 9)),
            0 if nw < 3 else 1 + _bin(common / nw, (0.01, 0.15, 0.3, 0.5)),
            _bin(letters, (0.5, 0.75, 0.88, 0.96)),
            0 if last in ".!?…" else 1 if last == "," else 2 if last == ";" else 3 if last == ":" else 4 if last.isalpha() else 5 if last.isdigit() else 6,
            # summed over the line: disorder counts the more, the longer the line that shows it
            0 if score is None else 1 if score < UNLIKE and score * (len(classes) - 1) < CERTAIN else 2 + _bin(score, (0.0, 0.14)),
            odd,
            0 if commas < 2 else 2 if entry_words <= 3.4 else 1,
            0 if n == 0 else 1 if body[:1].islower() and before and before[-1:] not in ".!?:;," else 2,
        )
        before = body
    return out


def seed_labels(x: np.ndarray) -> np.ndarray:
    """State by plain rules, -1 where they do not tell."""
    shape, words, common, letters, end, order, odd, commas, _ = (x[:, k] for k in range(x.shape[1]))
    y = np.full(len(x), -1)
    prose = np.isin(shape, (0,)) & (words >= 4) & (common >= 3) & (letters >= 3) & ~np.isin(order, (1, 2)) & (odd == 0) & (commas < 2)
    y[prose] = 0
    short = (shape == 0) & (words <= 3) & (letters >= 2) & (odd == 0)
    run = short & np.concatenate([[False], short[:-1]]) & np.concatenate([short[1:], [False]]) if len(x) else short
    y[run] = 1
    y[np.isin(shape, (1, 2)) & (words <= 4) & (odd == 0)] = 1
    y[np.isin(shape, (0, 1, 2)) & (commas == 2) & (words >= 3) & (odd == 0)] = 1
    y[np.isin(shape, (3, 4, 5, 6, 7)) & (common <= 2)] = 2
    y[np.isin(shape, (8, 9)) & (common <= 3)] = 3
    y[np.isin(odd, (1, 3, 4, 5))] = 3
    y[np.isin(order, (1, 2)) & (words == 5) & (letters >= 3) & (commas == 0) & (shape == 0)] = 3
    return y


def _prior() -> list[np.ndarray]:
    """Pseudo-counts per feature: what each state's lines look like."""
    def t(*rows):
        a = np.array(rows, float)
        return a / a.sum(1, keepdims=True)

    return [
        t([88, 2, 2, 0.2, 0.2, 0.2, 0.4, 1, 0.4, 0.6, 5], [40, 34, 20, 0.3, 0.3, 0.5, 0.5, 1, 0.4, 1, 1], [4, 1, 1, 18, 18, 20, 20, 14, 2, 1, 1], [34, 2, 2, 2, 1, 1, 4, 4, 20, 28, 2]),
        t([0.5, 3, 7, 10, 22, 57], [1, 14, 45, 27, 8, 5], [22, 24, 24, 14, 10, 6], [26, 16, 16, 14, 10, 18]),
        t([6, 1, 5, 15, 38, 35], [40, 24, 8, 16, 10, 2], [60, 34, 3, 2, 0.7, 0.3], [45, 28, 6, 6, 6, 9]),
        t([0.3, 0.7, 5, 30, 64], [2, 8, 20, 30, 40], [46, 34, 14, 4, 2], [32, 24, 14, 8, 22]),
        t([46, 5, 1, 1, 44, 2, 1], [18, 14, 14, 1, 42, 10, 1], [1, 1, 3, 3, 12, 55, 25], [6, 3, 2, 6, 40, 22, 21]),
        t([10, 0.4, 1.6, 13, 75], [86, 2, 3, 5, 4], [80, 4, 4, 8, 4], [62, 26, 6, 4, 2]),
        t([98.6, 0.3, 0.3, 0.3, 0.2, 0.3], [96, 1, 2, 0.5, 0.2, 0.3], [95, 2, 2, 0.4, 0.3, 0.3], [38, 20, 14, 12, 12, 4]),
        t([70, 28, 2], [74, 2, 24], [60, 5, 35], [90, 4, 6]),
        t([20, 45, 35], [8, 28, 64], [8, 10, 82], [8, 20, 72]),
    ]


class LineModel:
    """The hidden Markov model: start, transition and emission log chances."""

    def __init__(self, order: Order, strength: float = 60.0):
        self.order = order
        self.emission = [strength * p for p in _prior()]
        self.moves = strength * (np.full((4, 4), 0.02) + np.eye(4) * 0.92)
        self.start = strength * np.array([0.7, 0.1, 0.1, 0.1])
        self._logs()

    def _logs(self):
        log = lambda a: np.log(a / a.sum(-1, keepdims=True))
        self.log_e, self.log_m, self.log_s = [log(e) for e in self.emission], log(self.moves), log(self.start)
        self.log_e[list(SIZES).index("order")][0, 1] += CERTAIN  # at least the ratio the line itself shows

    def fit(self, docs: list[np.ndarray]) -> LineModel:
        """Add the frequencies of the lines that the rules label."""
        for x in docs:
            y = seed_labels(x)
            for s in range(4):
                own = x[y == s]
                for k, e in enumerate(self.emission):
                    if len(own):
                        # per document at most 20 lines' worth, so no one document rules
                        e[s] += np.bincount(own[:, k], minlength=e.shape[1]) * min(1.0, 20 / len(own))
            a, b = y[:-1], y[1:]
            ok = (a >= 0) & (b >= 0)
            np.add.at(self.moves, (a[ok], b[ok]), min(1.0, 20 / max(1, ok.sum())))
            if len(y) and y[0] >= 0:
                self.start[y[0]] += 1
        self._logs()
        return self

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Most probable state of each line (forward-backward posterior)."""
        n = len(x)
        if not n:
            return np.zeros(0, int)
        e = sum(self.log_e[k][:, x[:, k]] for k in range(x.shape[1])).T * 0.7  # features overlap; their weight is tempered
        e = np.exp(e - e.max(1, keepdims=True))
        m, a = np.exp(self.log_m), np.zeros((n, 4))
        a[0] = np.exp(self.log_s) * e[0]
        a[0] /= a[0].sum()
        for i in range(1, n):
            a[i] = (a[i - 1] @ m) * e[i]
            a[i] /= a[i].sum()
        b = np.ones(4)
        out = np.zeros(n, int)
        for i in range(n - 1, -1, -1):
            out[i] = int((a[i] * b).argmax())
            b = m @ (e[i] * b)
            b /= b.sum()
        return out

    def shares(self, text: str) -> tuple[int, int, list[int]]:
        """(lines, characters, characters per state) of a text."""
        lines = [s for s in text.split("\n") if s.strip()]
        y = self.labels(line_symbols(lines, self.order))
        size = np.array([len(s.strip()) for s in lines])
        per = [int(size[y == s].sum()) for s in range(4)]
        return len(lines), int(size.sum()), per


def train(docs: DataFrame, common: dict[str, set[str]], doc_id: str = "doc_id", text: str = "text", sample_docs: int = 4000, lines_per_doc: int = 400) -> LineModel:
    """Word order over all documents; line frequencies over about ``sample_docs``
    of them (at most ``lines_per_doc`` lines of each), chosen by a hash of the id."""
    src = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).filter(F.col(text).isNotNull())
    every = max(1, -(-docs.count() // sample_docs))
    part = src.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    plain = Order(common)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen: set[str] = set()
                for line in t.split("\n"):
                    if line not in seen:  # repeated lines teach no word order
                        seen.add(line)
                        g, c = plain.classes(line)
                        if len(c) >= 5:
                            n.update((g, *p) for p in zip(c, c[1:], strict=False))
        if n:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in n]) for i in range(3)), pa.array(list(n.values()), pa.int64())], names=["lang", "a", "b", "n"])

    counted = src.select("text").mapInArrow(pairs, "lang string, a string, b string, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    order = Order(common, {(r.lang, r.a, r.b): r.n for r in counted.collect()})  # at most (common words + 4) squared rows

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_symbols([s for s in t.split("\n") if s.strip()][:lines_per_doc], order).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    got = part.select("text").mapInArrow(symbols, "x binary").collect()
    return LineModel(order).fit([np.frombuffer(bytes(r.x), np.int8).reshape(-1, len(SIZES)) for r in got])


def label_shares(docs: DataFrame, model: LineModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_chars, prose_share, list_share, table_share, junk_share``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.shares(t) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64())]
            cols += [pa.array([g[2][s] / g[1] if g[1] else 0.0 for g in got], pa.float64()) for s in range(4)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_lines", "n_chars", *[f"{s}_share" for s in STATES]])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return src.mapInArrow(run, "doc_id long, n_lines int, n_chars long, prose_share double, list_share double, table_share double, junk_share double")


def not_prose(shares: DataFrame) -> Column:
    """More than half of the characters are list, table or junk."""
    return (F.col("n_chars") > 0) & (F.col("list_share") + F.col("table_share") + F.col("junk_share") > 0.5)

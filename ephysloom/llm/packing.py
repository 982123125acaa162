"""Filling fixed-capacity containers.

The plan is made on the histogram of lengths, not on the items: best fit in
descending order over counts, where containers with equal room form one range
of ids and a whole run of equal items is placed at once.  The histogram has at
most ``capacity`` entries, whatever the corpus, and so the plan's size is
bounded by the capacity alone; it is made on the driver and sent with the tasks.
Items then take the planned slots: an item's rank among those of its length,
found distributed (counts per length and hash bucket, then ranks within), leads
to its container by a binary search in the plan.

Defined results: an item longer than the capacity is cut into full pieces and a
rest, and nothing else is cut; an item of length 0 (null or empty text) goes to
container 0; repeated items are packed each; the result does not depend on the
partitioning.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Scratch

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the split pattern published with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens`` under a public byte-level vocabulary (a rank file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        enc = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit, descending, over counts: slot runs and number of containers.

    A run is (length, first rank, first container, items per container): the
    items of that length from that rank on take the run's containers in turn,
    until the next run's first rank.
    """
    runs: list[tuple[int, int, int, int]] = []
    rooms: list[int] = []  # rooms in use, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of container ids
    made = 0

    def put(room: int, lo: int, hi: int):
        if lo < hi and room > 0:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((lo, hi))

    for length in sorted((k for k in histogram if 0 < k <= capacity), reverse=True):
        rank, left = 0, histogram[length]
        at = bisect.bisect_left(rooms, length)
        taken: list[tuple[int, int, int]] = []  # what the filled containers have left
        while left and at < len(rooms):
            room = rooms[at]
            k = room // length
            spans = ranges[room]
            while left and spans:
                lo, hi = spans.pop()
                full = min(hi - lo, left // k)
                if full:
                    runs.append((length, rank, lo, k))
                    rank, left = rank + full * k, left - full * k
                    taken.append((room - k * length, lo, lo + full))
                    lo += full
                if lo < hi and left:  # fewer than k remain
                    runs.append((length, rank, lo, left))
                    taken.append((room - left * length, lo, lo + 1))
                    rank, left, lo = rank + left, 0, lo + 1
                if lo < hi:
                    spans.append((lo, hi))
            if not spans:
                del ranges[room], rooms[at]
            else:
                at += 1
        k = capacity // length
        full, rest = divmod(left, k)
        if full:
            runs.append((length, rank, made, k))
            taken.append((capacity - k * length, made, made + full))
            rank, made = rank + full * k, made + full
        if rest:
            runs.append((length, rank, made, rest))
            taken.append((capacity - rest * length, made, made + 1))
            made += 1
        for room, lo, hi in taken:
            put(room, lo, hi)
    if histogram.get(0):
        runs.append((0, 0, 0, histogram[0]))
        made = max(made, 1)
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 4), made


def pack(items: DataFrame, capacity: int = 2048, rows_per_bucket: int = 200_000) -> DataFrame:
    """``doc_id, piece_no, token_from, n_tokens, container_id`` from
    ``doc_id, n_tokens``.

    The buckets are as many as the rows ask for, so no task ranks more than about
    ``rows_per_bucket`` pieces of one length, however many share it.
    """
    keep = Scratch(items.sparkSession)
    cap = F.lit(capacity).cast("long")
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    pieces = F.greatest(F.ceil(n / cap).cast("long"), F.lit(1))
    p = items.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece_no"))
    p = keep.save(p.select("doc_id", "piece_no", (F.col("piece_no") * cap).alias("token_from"), F.least(cap, F.col("n") - F.col("piece_no") * cap).alias("n_tokens")))
    sizes = p.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()  # at most capacity + 1 rows
    histogram = {r.n_tokens: r.c for r in sizes}
    runs, _ = plan(histogram, capacity)
    buckets = max(16, -(-max(histogram.values(), default=0) // rows_per_bucket))
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    counts = p.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c"))  # at most capacity x buckets rows
    w = W.partitionBy("n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select("n_tokens", "bucket", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = p.withColumn("r", within).join(offset, ["n_tokens", "bucket"]).withColumn("rank", F.col("before") + F.col("r"))
    span = 1 << 44
    key = runs[:, 0] * span + runs[:, 1]

    @F.pandas_udf("long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(key, length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        return pd.Series(runs[at, 2] + (rank.to_numpy() - runs[at, 1]) // np.maximum(runs[at, 3], 1))

    return ranked.select("doc_id", "piece_no", "token_from", "n_tokens", slot("n_tokens", "rank").alias("container_id"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, share filled, and the lower bound on containers."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    r = per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("c").alias("n_pieces"), F.max("t").alias("fullest"))
    return r.select("*", (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("filled"), F.ceil(F.col("n_tokens") / capacity).alias("least_containers"))

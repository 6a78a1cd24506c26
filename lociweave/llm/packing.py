"""Packing into sequences by cutting-stock column generation.

A document's ids are cut into pieces of ``LENGTH`` and a rest. Pieces fall into classes of
``STEP`` tokens, rounded up. The classes' counts, at most ``LENGTH / STEP`` numbers, go to
the driver; there a linear program over patterns (how many pieces of each class fill a
sequence) is solved by revised simplex, with a knapsack dynamic program that prices new
patterns. Whole multiples of the patterns are kept; the fewer than one of each that remain
are filled first-fit by size. A piece's rank in its class then says its sequence and place.

Documents are encoded once; the pieces with their ids are a table in the shared folder, and
the later steps read its narrow columns. Ranks come from counts of each (part, class), so no
class, however many pieces it has, meets in one task. A sequence has ``LENGTH`` tokens at most.

Defined results: null or empty texts are the end id alone. Repeated rows are documents of
their own. A doc_id is a whole number, or a text
of one; others end with Spark's cast error. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tokens import BATCH_BYTES, encoder
from .words import ragged_arange
from .work import Workspace, text_slices

LENGTH, STEP = 2048, 8
#: The program ends when no solution can be better by more than this share (or half a sequence), or after so many
#: steps for each class; what it has then is a whole solution too.
GAP, STEPS = 5e-4, 8

PIECES = "part int, doc_id long, start long, length int, size int, place long, doc_tokens long, ids_crc32 long, ids binary"


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over sizes 1..len(values): the most that fits into ``capacity``, and how many of each size."""
    sizes = len(values)
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(room, sizes)
        gain = best[room - k : room][::-1] + values[:k]
        at = int(np.argmax(gain))
        if gain[at] > best[room - 1] + 1e-12:
            best[room], taken[room] = gain[at], at + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(sizes, np.int64), capacity
    while room > 0:
        if taken[room]:
            counts[taken[room] - 1] += 1
            room -= taken[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def solve(demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """Patterns with whole multiplicities that cover ``demand[i]`` pieces of size i + 1, in few sequences of ``capacity``."""
    have = np.flatnonzero(demand > 0)
    if not len(have):
        return []
    m = len(have)
    need = demand[have].astype(float)
    patterns = np.zeros((m, m))  # a column for each basic variable
    np.fill_diagonal(patterns, capacity // (have + 1))
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ need
    bound = float(demand @ np.arange(1, len(demand) + 1)) / capacity
    for _ in range(STEPS * m):
        prices = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[have] = np.maximum(prices, 0)
        worth, counts = best_pattern(values, capacity)
        bound = max(bound, float(values[have] @ need) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or x.sum() - bound < max(gap * bound, 0.5):
            break
        column = counts[have].astype(float)
        direction = (inverse * column).sum(axis=1)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        patterns[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= direction[:, None] * row
        inverse[out] = row
        x = np.maximum((inverse * need).sum(axis=1), 0)
    x = np.linalg.solve(patterns, need)
    found, left = [], demand.astype(np.int64).copy()
    for k in range(m):
        counts = np.zeros(len(demand), np.int64)
        counts[have] = np.rint(patterns[:, k]).astype(np.int64)
        if times := int(np.floor(x[k] + 1e-9)):
            found.append((times, counts))
            left -= times * counts
    return found + fill(np.maximum(left, 0), capacity)


def fill(left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """What rounding down leaves, first-fit from the largest; fewer sequences than there are classes, for any input."""
    rooms, bins = np.zeros(0, np.int64), []
    for size in range(len(left), 0, -1):
        for _ in range(int(left[size - 1])):
            at = int(np.argmax(rooms >= size)) if len(rooms) else 0
            if not len(rooms) or rooms[at] < size:
                at = len(bins)
                bins.append(np.zeros(len(left), np.int64))
                rooms = np.append(rooms, capacity)
            bins[at][size - 1] += 1
            rooms[at] -= size
    return [(1, b) for b in bins]


def _cut(path: str, end_id: int, length: int, step: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(length // step + 1, np.int64)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", BATCH_BYTES):
                ids, at = encoder(path).ids(rows.column(1), data, offsets, end_id)
                totals = np.diff(at)
                pieces = -(-totals // length)
                doc = np.repeat(np.arange(len(totals)), pieces)
                start = ragged_arange(pieces) * length
                n = np.minimum(length, totals[doc] - start)
                size = -(-n // step)
                order = np.argsort(size, kind="stable")
                classes = np.bincount(size, minlength=len(seen))
                place = np.empty(len(size), np.int64)  # among the task's pieces of a class
                place[order] = ragged_arange(classes) + np.repeat(seen, classes)
                seen += classes
                borders = np.append(at[doc] + start, at[-1])
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
                # ids that fit are stored in 16 bits; the width follows from the piece's length
                kind = "<u2" if ids.max() < 1 << 16 else "<u4"
                ends = (borders * np.dtype(kind).itemsize).astype(np.int64)
                body = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                columns = [
                    pa.array(np.full(len(n), part, np.int32)), rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(n, pa.int32()), pa.array(size, pa.int32()),
                    pa.array(place), pa.array(totals[doc]), pa.array(crcs, pa.int64()), body,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _place(plan: list[tuple[int, np.ndarray]], classes: int) -> tuple[list[np.ndarray], ...]:
    """For each class, over the patterns that use it: ranks where they begin, their first sequence, and pieces in each sequence."""
    begins, firsts, each = ([[] for _ in range(classes + 1)] for _ in range(3))
    used, sequence = np.zeros(classes + 1, np.int64), 0
    for times, counts in plan:
        for c in np.flatnonzero(counts) + 1:
            n = int(counts[c - 1])
            begins[c].append(int(used[c]))
            firsts[c].append(sequence)
            each[c].append(n)
            used[c] += times * n
        sequence += times
    return tuple([np.array(v, np.int64) for v in x] for x in (begins, firsts, each))


def _sequence(plan: list[tuple[int, np.ndarray]], classes: int, size: Column, rank: Column) -> Column:
    begins, firsts, each = _place(plan, classes)

    @F.pandas_udf("long")
    def sequence(size: pd.Series, rank: pd.Series) -> pd.Series:
        sizes, ranks = size.to_numpy(), rank.to_numpy()
        out = np.zeros(len(sizes), np.int64)
        for c in np.unique(sizes):
            mine = sizes == c
            at = np.searchsorted(begins[c], ranks[mine], side="right") - 1
            out[mine] = firsts[c][at] + (ranks[mine] - begins[c][at]) // each[c][at]
        return pd.Series(out)

    return sequence(size, rank)


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, step: int = STEP, text: str = "text") -> DataFrame:
    """Pieces of all ``docs``: doc_id, start, length, ids (as bytes), ids_crc32, doc_tokens, sequence_id, offset."""
    work = Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = work.table(rows.mapInArrow(_cut(path, end_id, length, step), PIECES), "pieces")
    counts = work.table(pieces.groupBy("size", "part").agg(F.count("*").alias("n")), "counts")
    classes = length // step
    demand = np.zeros(classes, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # a row for each class
        demand[r["size"] - 1] = r["n"]
    plan = solve(demand, classes)
    before = F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).drop("n")
    ranked = pieces.join(offsets, ["size", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    placed = ranked.withColumn("sequence_id", _sequence(plan, classes, F.col("size"), F.col("rank")))
    along = W.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, pieces): each sequence's pieces in order, with their ids' bytes."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")

"""Hierarchical residual packing: best fit in parts, then trees of what they leave.

1. Texts are encoded where they lie and, only where longer than a sequence, cut into pieces.
   The pieces with their ids are a table in the shared folder; what follows reads its narrow
   columns.
2. Pieces are dealt by a hash to parts of ``PART_ITEMS``, so that every part has the lengths of
   the whole. A task packs its part by best fit, longest first: a piece goes to the fullest
   open sequence that has room. Sequences that are nearly full are done.
3. The rest are items of the next round, with what they hold as their length: ``FAN_IN``
   parts' residuals meet in one task, again by best fit, and so on until one part is left. A
   part hands on at most ``RESIDUALS`` sequences, those with the most room; by best fit no two
   of them are half empty, so it is the small ones that find room in others.
4. A piece's sequence and place follow from the rounds' tables of (item, sequence, place).

Every task holds a bounded number of items, whatever the input; nothing is collected but counts.

Defined results: null or empty texts are the end id alone. Repeated rows are documents of their
own, and doc_ids of any type stay as they are, null included. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import BATCH_BYTES, encoder
from .words import ragged_arange
from .work import Workspace, text_slices

LENGTH = 4096
#: Tokens that a sequence may lack and count as full.
SLACK = 8
#: Pieces of a part in the first round, parts whose residuals meet in a task, and residuals that a part hands on.
PART_ITEMS, FAN_IN, RESIDUALS = 4096, 16, 1024

PIECES = "item long, piece int, start long, length int, doc_tokens long, ids_crc32 long, ids binary"
PLACED = "item long, bin long, place int, held int, done boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and place of each length, and what each sequence holds: longest first, into the fullest sequence with room.

    A word of ``capacity + 1`` bits says which rooms some open sequence has, so a step costs no search.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, places, held = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int32), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for at, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, own = capacity, len(held)
            held.append(0)
        bins[at], places[at] = own, held[own]
        held[own] += size
        if left := room - size:
            if not rooms[left]:
                open_rooms |= 1 << left
            rooms[left].append(own)
    return bins, places, np.array(held, np.int32)


def _cut(path: str, end_id: int, length: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", BATCH_BYTES):
                ids, at = encoder(path).ids(rows.column(1), data, offsets, end_id)
                totals = np.diff(at)
                pieces = -(-totals // length)
                doc, piece = np.repeat(np.arange(len(totals)), pieces), ragged_arange(pieces)
                start = piece * length
                borders = np.append(at[doc] + start, at[-1])
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
                # ids that fit are stored in 16 bits; the width follows from the piece's length
                kind = "<u2" if ids.max() < 1 << 16 else "<u4"
                ends = (borders * np.dtype(kind).itemsize).astype(np.int64)
                body = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                columns = [
                    rows.column(0).take(pa.array(doc)), pa.array(seen + np.arange(len(doc))), pa.array(piece, pa.int32()), pa.array(start),
                    pa.array(np.diff(borders), pa.int32()), pa.array(totals[doc]), pa.array(crcs, pa.int64()), body,
                ]
                seen += len(doc)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    return run


def _round(capacity: int, residuals: int, level: int, last: bool):
    """Packs one part: its items' sequences, those that are done marked. Sequences are numbered by round, part and place."""

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        # the same order whatever order rows come in, so that a part that is packed again gets the same numbers
        items = items.sort_values("item")
        bins, places, held = best_fit(items["length"].to_numpy(), capacity)
        done = np.ones(len(held), bool)
        if not last:
            rest = np.argsort(held, kind="stable")[:residuals]
            done[rest] = held[rest] >= capacity - SLACK
        number = (np.int64(level) << 58) | (np.int64(key[0]) << 28)
        return pd.DataFrame({"item": items["item"].to_numpy(), "bin": number + bins, "place": places, "held": held[bins], "done": done[bins]})

    return run


def pieces(docs: DataFrame, work: Workspace, path: str, end_id: int = 1, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, item, piece, start, length, doc_tokens, ids_crc32, ids): pieces of all ``docs``, as the table ``pieces`` of ``work``."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    return work.table(rows.mapInArrow(_cut(path, end_id, length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}"), "pieces")


def assign(items: DataFrame, work: Workspace, capacity: int = LENGTH, part_items: int = PART_ITEMS, fan_in: int = FAN_IN, residuals: int = RESIDUALS) -> DataFrame:
    """(item, sequence_id, offset) of all ``items`` (item long, length int): each in one sequence of at most ``capacity``."""
    parts = max(1, -(-items.count() // part_items))
    here, levels = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("group")), []
    while True:
        last = parts == 1
        packed = here.groupBy("group").applyInPandas(_round(capacity, residuals, len(levels), last), PLACED)
        levels.append(work.table(packed, f"round-{len(levels)}"))
        if last:
            break
        rest = levels[-1].where("NOT done AND place = 0")
        # a sequence's number has its part, and neighbouring parts meet
        group = F.shiftright(F.col("bin").bitwiseAND((1 << 58) - 1), 28) / fan_in
        here = rest.select(F.col("bin").alias("item"), F.col("held").alias("length"), F.floor(group).alias("group"))
        parts = -(-parts // fan_in)
    # from the last round back: where each round's sequences come to lie
    found = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"), "done")
        if found is not None:
            above = found.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("of"), F.col("offset").alias("before"))
            moved = own.where("NOT done").join(above, "sequence_id").select("item", F.col("of").alias("sequence_id"), (F.col("before") + F.col("offset")).alias("offset"))
            found = own.where("done").drop("done").unionByName(moved)
        else:
            found = own.drop("done")
    return found


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, text: str = "text", **options) -> DataFrame:
    """Pieces of all ``docs`` with their ids and places: doc_id, piece, start, length, ids (as bytes), ids_crc32, doc_tokens, sequence_id, offset."""
    work = Workspace(docs.sparkSession, "residual-packing")
    cut = pieces(docs, work, path, end_id, length, text)
    placed = assign(cut.select("item", "length"), work, length, **options)
    return cut.join(placed, "item").select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"),
    )


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")

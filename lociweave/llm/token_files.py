"""Token files of directly addressable codes.

An id is cut into 8-bit chunks. Level k holds the k-th chunks of all ids that reach it, a
bitmap that says which of them go on, and a rank directory over the bitmap. The chunk of
id i on the next level lies at the number of bits set before i, so any token is read with
one byte and one count for each level, and no block is decoded.

A file row is one shard: consecutive documents in ascending doc_id order, coded together.
Shards are written by Spark, so a lost executor's part is written again and files appear
as a whole. The position of a shard follows from (part, seq). The codes lie in their files as
they are, without compression, so what is read of a shard is not unpacked either: ``tokens_at``
reads single tokens by position, ``documents`` whole documents by id, both through the ranks.

Defined results: null or empty texts are the end id alone. A null doc_id comes first;
equal doc_ids are ordered by text. A doc_id is a whole number, or a text
of one; others end with Spark's cast error. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tokens import BATCH_BYTES, encoder
from .work import Workspace, text_slices

#: Tokens of a shard; the document that reaches this many ends it.
SHARD_TOKENS = 500_000
#: Bytes of texts in a range of doc_ids, about, where there are more than the session's number of partitions holds.
RANGE_BYTES = 128_000_000
#: Bits that one entry of a rank directory covers.
RANK_BITS = 512
#: Positions that are looked up at a time.
TAKE_ROWS = 65_536
_HEAD = struct.Struct("<4sQI")
_LEVEL = struct.Struct("<QQQ")

SHARDS = "part int, seq int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"


def encode(ids: np.ndarray) -> bytes:
    """The coded form of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64))[:-1]]).astype("<u4")
        levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
    head = _HEAD.pack(b"DAC1", len(ids), len(levels))
    return head + b"".join(_LEVEL.pack(*map(len, x)) for x in levels) + b"".join(b"".join(x) for x in levels)


class Codes:
    """Reader of one coded form; nothing is copied."""

    def __init__(self, data: bytes):
        magic, self.n, count = _HEAD.unpack_from(data)
        if magic != b"DAC1":
            raise ValueError("not a token file")
        at, self.levels = _HEAD.size + count * _LEVEL.size, []
        for k in range(count):
            level = []
            for size, kind in zip(_LEVEL.unpack_from(data, _HEAD.size + k * _LEVEL.size), (np.uint8, np.uint8, np.dtype("<u4")), strict=True):
                level.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(level)

    def __getitem__(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            before = bits[block * RANK_BITS // 8 : (i >> 3) + 1].copy()
            before[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(before).sum())
        return value

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions: for each level one byte, one bit and one count each, whatever the number of ids."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("outside the coded ids")
        out, rows = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[rows] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            on = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            rows, at = rows[on], at[on]
            if not len(at):
                break
            # bits before each position within its rank block
            block = at // RANK_BITS
            first = block * (RANK_BITS // 8)
            lanes = np.arange(RANK_BITS // 8)
            after = np.empty(len(at), np.int64)
            for a in range(0, len(at), TAKE_ROWS):
                s = slice(a, a + TAKE_ROWS)
                where = first[s, None] + lanes
                held = bits[np.minimum(where, len(bits) - 1)]
                last = (at[s] >> 3)[:, None]
                held = np.where(where < last, held, np.where(where == last, held & ((1 << (at[s] & 7)) - 1).astype(np.uint8)[:, None], 0)).astype(np.uint8)
                after[s] = ranks[block[s]] + np.bitwise_count(held).sum(1, dtype=np.int64)
            at = after
        return out

    def all(self) -> np.ndarray:
        """All ids."""
        out, at = np.zeros(self.n, np.uint32), np.arange(self.n)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
        return out


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "n_tokens": total, "doc_ids": pa.concat_arrays(docs), "doc_tokens": np.concatenate(counts), "codes": encode(np.concatenate(held))}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", BATCH_BYTES):
                ids, at = encoder(path).ids(rows.column(1), data, offsets, end_id)
                begin = 0
                while begin < rows.num_rows:  # a step for each shard that the batch touches
                    end = int(np.searchsorted(at, at[begin] + shard_tokens - total))
                    end = min(max(end, begin + 1), rows.num_rows)
                    docs.append(rows.column(0).slice(begin, end - begin))
                    counts.append(np.diff(at[begin : end + 1]))
                    held.append(ids[at[begin] : at[end]])
                    total += int(at[end] - at[begin])
                    begin = end
                    if total >= shard_tokens:
                        yield shard()
                        seq += 1
                        docs, counts, held, total = [], [], [], 0
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, work: Workspace, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, text: str = "text") -> DataFrame:
    """Token files of ``docs`` in ascending doc_id order, as the table ``tokens`` of ``work``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return work.table(rows.mapInArrow(_write(path, end_id, shard_tokens), SHARDS), "tokens", compression="none")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): tokens before each shard. Sums within a part, and one row for each part over the parts."""
    rows = shards.select("part", "seq", "n_tokens")
    before = lambda by, what: F.coalesce(F.sum(what).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("part_start", before(W.orderBy("part"), "n")).drop("n")
    own = rows.withColumn("own_start", before(W.partitionBy("part").orderBy("seq"), "n_tokens"))
    return own.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("own_start")).alias("shard_start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Codes(row["codes"]).all().astype("<u4").tobytes()
            counts = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(ids[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["shard_start"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    rows = shards.drop("n_tokens").join(shard_starts(shards), ["part", "seq"])
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (codes, shard_start, at) to (position, id)."""
    for batch in batches:
        for row in range(batch.num_rows):
            at = np.sort(batch.column(2)[row].values.to_numpy())
            ids = Codes(batch.column(0)[row].as_buffer()).take(at)
            yield pa.RecordBatch.from_arrays([pa.array(at + batch.column(1)[row].as_py()), pa.array(ids.astype(np.int64))], names=["position", "id"])


def tokens_at(shards: DataFrame, positions: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(position, id) of each distinct ``position`` (long) over all documents that there is; null and other positions give no row.

    A position meets its shard by an equi-join of ranges of ``shard_tokens`` positions. Only a shard that is asked for is
    read, once, with its own positions, at most as many as it has tokens.
    """
    starts = shard_starts(shards).join(shards.select("part", "seq", "n_tokens"), ["part", "seq"])
    spans = starts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("shard_start") / shard_tokens), F.floor((F.col("shard_start") + F.col("n_tokens") - 1) / shard_tokens))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    asked = asked.withColumn("cell", F.floor(F.col("position") / shard_tokens))
    inside = (F.col("position") >= F.col("shard_start")) & (F.col("position") < F.col("shard_start") + F.col("n_tokens"))
    met = asked.join(spans, "cell").where(inside)
    lists = met.groupBy("part", "seq", "shard_start").agg(F.collect_list(F.col("position") - F.col("shard_start")).alias("at"))
    return shards.select("part", "seq", "codes").join(lists, ["part", "seq"]).select("codes", "shard_start", "at").mapInArrow(_take, "position long, id long")


def _take_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (codes, shard_start, docs) to a row for each document, in batches of at most ``TAKE_ROWS`` tokens, or one document."""
    names = ["doc_id", "start", "n_tokens", "ids"]
    for batch in batches:
        for row in range(batch.num_rows):
            codes, shard_start = Codes(batch.column(0)[row].as_buffer()), batch.column(1)[row].as_py()
            docs = sorted(batch.column(2)[row].as_py(), key=lambda d: d["at"])
            while docs:
                n, total = 0, 0
                while n < len(docs) and (not n or total + docs[n]["n"] <= TAKE_ROWS):
                    total += docs[n]["n"]
                    n += 1
                mine, docs = docs[:n], docs[n:]
                counts = np.array([d["n"] for d in mine])
                at = np.concatenate([np.arange(d["at"], d["at"] + d["n"]) for d in mine])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.take(at).astype(np.int64)))
                columns = [pa.array([d["doc_id"] for d in mine], pa.int64()), pa.array([d["at"] + shard_start for d in mine], pa.int64()), pa.array(counts.astype(np.int64)), ids]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def documents(shards: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) of each stored document whose doc_id is among ``doc_ids``, which may repeat; equal doc_ids are a row each.

    A null among ``doc_ids`` gives the documents without an id. Only shards that hold one are read, once.
    """
    every = shards.select("part", "seq", F.posexplode(F.arrays_zip("doc_ids", "doc_tokens")).alias("x", "d"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("part", "seq").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every = every.select("part", "seq", "x", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_tokens").alias("n")).withColumn("at", before)
    asked = doc_ids.select(F.col("doc_id").cast("long").alias("_asked")).distinct()
    found = every.join(asked, F.col("doc_id").eqNullSafe(F.col("_asked")), "left_semi")
    lists = found.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "at", "n")).alias("docs"))
    rows = shards.select("part", "seq", "codes").join(lists, ["part", "seq"]).join(shard_starts(shards), ["part", "seq"])
    return rows.select("codes", "shard_start", "docs").mapInArrow(_take_documents, "doc_id long, start long, n_tokens long, ids array<long>")


def query(docs: DataFrame) -> DataFrame:
    work = Workspace(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, work, public_tokenizers.path("byte_bpe_50k.json")))

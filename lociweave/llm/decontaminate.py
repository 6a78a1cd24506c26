"""Benchmark decontamination with suffix arrays of the training documents.

Each task builds suffix arrays over shards of its documents' words and binary-searches
every suffix of the benchmark in them: the range of training suffixes that begin with the
suffix's window, and the ranges of all its beginnings, which give every training position its
longest verbatim match. Words are 64-bit hashes; a shard's suffixes
are sorted to the depth of the longest benchmark item, which no comparison goes beyond.

A window is ``WINDOW`` consecutive item words; an item of fewer words, but not none, is one
window. Nothing is shuffled, so documents, copies and passages of any frequency stay where
they were read. The benchmark is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of
text, each block a pass over the documents; one block is what a usual benchmark has.

Defined results: null or empty texts have no words and no hits. Rows are judged one by one,
repeated ones too. Null item texts have no windows. Items without an id hit as others do; among
``items`` they are one null, last, which counts and has no place in the list's digest. ``clean`` keeps all columns as they are;
``matches`` returns those of ``keep``, which its own names may not clash with. An empty table on either side gives no matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALPHANUMERIC, mix, ragged_arange, word_hashes
from .work import Workspace, numbered, text_slices

WINDOW = 10
#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 8_000_000
#: Bytes of documents in a shard; a longer document has one of its own.
SHARD_BYTES = 4_000_000

MATCHES = "n_words long, hits array<struct<start:long,length:long>>, items array<string>, longest long"


def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the words from there to the document's end, to ``depth`` words at least, and the ranks of single words.

    Prefix doubling: an order by 2k words follows from the order by k. Only suffixes that are still tied are sorted anew.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a suffix's rank is where its group begins
    rank[order] = group + 1
    k = 1
    while k < depth:
        last = np.ones(n, bool)
        last[:-1] = group[1:] != group[:-1]
        first = np.ones(n, bool)
        first[1:] = last[:-1]
        tied = np.flatnonzero(~(first & last))
        if not len(tied):
            break
        at = order[tied]
        after = np.where(at + k < ends[at], rank[np.minimum(at + k, n - 1)], 0)
        sub = np.argsort(group[tied] * (n + 2) + after, kind="stable")
        at, after, old = at[sub], after[sub], group[tied][sub]
        order[tied] = at
        split = np.ones(len(tied), bool)
        split[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        group[tied] = tied[np.flatnonzero(split)[np.cumsum(split) - 1]]
        rank[at] = group[tied] + 1
        k *= 2
    return order, rank


def search(order: np.ndarray, words: np.ndarray, ends: np.ndarray, asked: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query, ``lengths`` words of ``asked`` from ``starts``, the range [low, high) of suffixes that begin with it."""

    def first(after: bool) -> np.ndarray:
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            below, equal = np.zeros(len(starts), bool), open_.copy()  # the suffix is below the query; equal so far
            for j in range(int(lengths.max(initial=0))):
                if not (live := equal & (lengths > j)).any():
                    break
                here = at + j
                has = here < ends[at]
                word = words[np.minimum(here, len(words) - 1)]
                wanted = asked[np.minimum(starts + j, len(asked) - 1)]
                below |= live & (~has | (word < wanted))
                equal &= ~live | (has & (word == wanted))
            go_right = below | (equal & after)
            low = np.where(open_ & go_right, middle + 1, low)
            high = np.where(open_ & ~go_right, middle, high)
        return low

    return first(False), first(True)


class Benchmark:
    """Words of a block of items one after another; its distinct windows as places in them, with the items that have them; its suffixes.

    All of it grows in proportion to the items' words.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        raw = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.words, first = word_hashes(data, np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]), ALPHANUMERIC)
        counts = np.diff(first)
        self.depth = max(window, int(counts.max(initial=0)))
        self.ids = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))  # the missing one last
        number = {i: k for k, i in enumerate(self.ids)}
        owner = np.array([number[i] for i, _ in items], np.int64)
        n_windows = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        starts = np.repeat(first[:-1], n_windows) + ragged_arange(n_windows)
        lengths = np.repeat(np.minimum(counts, window), n_windows)
        key = lengths.astype(np.uint64)
        for j in range(window):
            inside = lengths > j
            key[inside] = mix(key[inside] * np.uint64(3) + self.words[starts[inside] + j])
        _, one, group = np.unique(key, return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[one], lengths[one]
        pairs = np.unique(np.stack([group, np.repeat(owner, n_windows)]), axis=1) if len(group) else np.zeros((2, 0), np.int64)
        self.items, self.items_from = pairs[1], np.searchsorted(pairs[0], np.arange(len(one) + 1))
        # a suffix begins at each word of the distinct item texts
        texts = {self.words[p:q].tobytes(): (p, q) for p, q in zip(first[:-1], first[1:], strict=True)}
        spans = np.array(list(texts.values()), np.int64).reshape(-1, 2)
        sizes = spans[:, 1] - spans[:, 0]
        self.suffixes = np.repeat(spans[:, 0], sizes) + ragged_arange(sizes)
        self.suffix_lengths = np.repeat(spans[:, 1], sizes) - self.suffixes


def longest_matches(order: np.ndarray, words: np.ndarray, ends: np.ndarray, bench: Benchmark) -> np.ndarray:
    """For each position the words of its longest match with any suffix of the benchmark.

    All suffixes of the benchmark go down the array together, a word at a time. The ranges of distinct beginnings of
    one length are disjoint and those of longer ones lie inside, so as many ranges cover a position as words match.
    """
    n, rows = len(order), np.arange(len(bench.suffixes))
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
    change = np.zeros(n + 1, np.int64)
    for j in range(bench.depth):
        keep = bench.suffix_lengths[rows] > j
        rows, low, high = rows[keep], low[keep], high[keep]
        low, high = _narrow(order, words, ends, bench.words[bench.suffixes[rows] + j], j, low, high)
        keep = high > low
        rows, low, high = rows[keep], low[keep], high[keep]
        if not len(rows):
            break
        begin, one = np.unique(low, return_index=True)
        change[begin] += 1
        np.add.at(change, high[one], -1)
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(change[:-1])
    return out


def _narrow(order: np.ndarray, words: np.ndarray, ends: np.ndarray, wanted: np.ndarray, j: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range of suffixes with the same first ``j`` words the part whose next word is the wanted one."""

    def first(after: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            middle = (a + b) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            here = at + j
            word = words[np.minimum(here, len(words) - 1)]
            right = (here >= ends[at]) | (word < wanted) | ((word == wanted) & after)
            a, b = np.where(open_ & right, middle + 1, a), np.where(open_ & ~right, middle, b)
        return a

    return first(False), first(True)


def _find(bench: Benchmark, rows: int, data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Of each document of a shard: words, runs of hit words, items and the longest match."""
    words, first = word_hashes(data, offsets, ALPHANUMERIC)
    counts = np.diff(first)
    hits: list[list[dict]] = [[] for _ in range(rows)]
    items: list[list[str | None]] = [[] for _ in range(rows)]
    longest = np.zeros(rows, np.int64)
    if not len(words) or not len(bench.starts):
        return counts, hits, items, longest
    ends = np.repeat(first[1:], counts)
    owner = np.repeat(np.arange(rows), counts)
    order, _ = suffix_array(words, ends, bench.depth)
    longest[counts > 0] = np.maximum.reduceat(longest_matches(order, words, ends, bench), first[:-1][counts > 0])
    low, high = search(order, words, ends, bench.words, bench.starts, bench.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return counts, hits, items, longest
    which = np.repeat(found, (high - low)[found])
    at = order[ragged_arange((high - low)[found]) + np.repeat(low[found], (high - low)[found])]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + bench.lengths[which], -1)
    covered = np.cumsum(change[:-1]) > 0
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    begins[first[:-1][counts > 0]] |= covered[first[:-1][counts > 0]]
    stops = covered.copy()
    stops[:-1] &= ~covered[1:]
    stops[first[1:][counts > 0] - 1] |= covered[first[1:][counts > 0] - 1]
    for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(stops).tolist(), strict=True):
        doc = int(owner[a])
        hits[doc].append({"start": a - int(first[doc]), "length": b - a + 1})
    pairs = np.unique(np.stack([owner[at], which]), axis=1)  # documents and windows
    n_items = np.diff(bench.items_from)[pairs[1]]
    own = bench.items[np.repeat(bench.items_from[pairs[1]], n_items) + ragged_arange(n_items)]
    for doc, item in np.unique(np.stack([np.repeat(pairs[0], n_items), own]), axis=1).T.tolist():
        items[doc].append(bench.ids[item])  # in the order of the ids
    return counts, hits, items, longest


def _ids(items: set[str | None]) -> list[str | None]:
    """Item ids in order, the missing one last."""
    return sorted(items - {None}) + [None] * (None in items)


def _merge(runs: list[dict]) -> list[dict]:
    """Runs of words as disjoint runs in order."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["start"]):
        if out and r["start"] <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], r["start"] + r["length"] - out[-1]["start"])
        else:
            out.append(dict(r))
    return out


def _run(sent, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = sent.value  # kept by the worker
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text, SHARD_BYTES):
                counts, hits, items, longest = _find(bench, rows.num_rows, data, offsets)
                if "hits" in rows.schema.names:  # an earlier block's
                    hits = [_merge((a or []) + b) for a, b in zip(rows.column("hits").to_pylist(), hits, strict=True)]
                    items = [_ids({*(a or []), *b}) for a, b in zip(rows.column("items").to_pylist(), items, strict=True)]
                    longest = np.maximum(rows.column("longest").to_numpy(), longest)
                kept = [rows.column(c) for c in keep]
                run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                found = [pa.array(counts, pa.int64()), pa.array(hits, run_type), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays(kept + found, names=[*keep, "n_words", "hits", "items", "longest"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, with n_words, hits (runs of hit words), items (sorted ids with occurring windows, a null for items without one) and longest (words of the longest verbatim match)."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    work = Workspace(spark, "decontaminate") if blocks > 1 else None
    out = docs.select(*keep, *([text] if text not in keep else []))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in block.collect()], window))  # of BLOCK_BYTES or so, whatever the benchmark's size
        columns = [*keep] if k == blocks - 1 or text in keep else [*keep, text]
        kept = out.select(*columns)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        out = out.mapInArrow(_run(sent, columns, text), f"{ddl}, {MATCHES}")
        if k < blocks - 1:
            out = work.table(out, f"block-{k}")
            work.drop(f"block-{k - 1}")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that have a hit, with all their columns as they are, whatever their names."""
    rows = numbered(docs)
    names = rows.columns
    return matches(rows, benchmark, window, tuple(names), names[docs.columns.index("text")]).where(F.size("hits") == 0).select(*names).toDF(*docs.columns)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = matches(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["length"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: DuckDB SQL from tables ``docs`` (doc_id, text) and ``benchmark`` to ``leaks`` (doc_id, n_words, n_hit, items).
LEAKS_SQL = r"""
doc_words AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM docs),
item_words AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, d.n, i, item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.g = t.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id),
leaks AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items
  FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN hit_items USING (doc_id))"""
ORACLE_SQL = f"""WITH docs AS (SELECT doc_id, text FROM documents), {LEAKS_SQL}
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AS contaminated FROM leaks"""

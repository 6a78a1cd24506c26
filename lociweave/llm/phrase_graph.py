"""Phrase collocations from a weighted de Bruijn graph of words.

The texts of a language are pieces of words. At each word begins a gram of up to ``LONGEST``
words, shorter only where the piece ends: a gram of full length is an edge between its first
and its last ``LONGEST - 1`` words as nodes, a shorter one is a piece's end.

1. Sums of hashes of words and of pairs of words give a bitmap of those that may occur
   ``least`` times. It has a fixed size, so it may be sent to every task, and it errs on one
   side only: a phrase that occurs often enough has all its words and pairs in it. Elsewhere
   pieces are cut, which no such phrase feels.
2. Edges and ends are counted, by the words themselves. A hash decides nothing.
3. A node's count is the flow out of it, the counts of the grams of one more word that begin
   with it, and the pieces that end there. So shorter counts follow from longer ones level by
   level, and texts are not counted again.
4. Unary paths: a phrase whose whole flow goes through one longer phrase is an inner node of
   that one's path and is taken up by it. One word more, in front or behind, decides: if some
   longer phrase has the same count, so has one of one word more. ``paths`` joins the edges of
   such chains to whole repeated passages.
5. Each remaining phrase is scored at its weakest cut, in exact decimals, and ranked in its
   language: first in many shares of the phrases, then among those shares' best.

Defined results: null or empty texts have no words; a null language is ``und``, together with
rows of that language. doc_id is not read, repeated rows count each, other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .words import LOWER, mix, ragged_arange, word_hashes
from .work import Workspace, text_slices

LONGEST, LEAST, BEST = 5, 100, 2000
#: Bits of the map of frequent words and pairs: 8 MB. When more than some ten million are frequent it cuts less; results stay.
BITS = 1 << 26
#: Hashes that a task holds before it gives their sums.
HELD = 1_500_000
#: Bytes of texts that are worked on together. A longer text goes alone.
SLICE = 1_000_000

#: Kinds of bytes: 0 of words, 1 blanks, 2 ends of pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_PAIR, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Slice:
    """Words of some texts: their bytes with one blank behind each, hashes, languages, and where pieces end."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        inside = kind == 0
        self.hashes, first = word_hashes(data, offsets, _KIND == 0)
        self.n = len(self.hashes)
        after = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1  # every text ends with a line's end
        ends = np.concatenate([[0], np.cumsum(kind == 2)])
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        self.last = np.ones(self.n, bool)
        self.last[:-1] = ends[starts[1:]] > ends[after[:-1]]
        self.bytes = LOWER[data[inside]]
        self.begins = np.concatenate([[0], np.cumsum(after - starts)])
        coded = langs.fill_null("und").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(first))
        seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.seed = seeds[self.lang]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words, and of each word with the next one (of no meaning where the piece ends), by language."""
        own = self.hashes + self.seed
        return mix(own * _ONE), mix(own * _PAIR + np.append(self.hashes[1:], np.uint64(0)))

    def words(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_string(), self.n, [None, pa.py_buffer(self.begins.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.bytes))])

    def texts(self, at: np.ndarray, count: np.ndarray) -> pa.Array:
        """The phrases of ``count`` words that begin at the words ``at``."""
        sizes = self.begins[at + count] - self.begins[at] + count - 1
        spaced = np.full(len(self.bytes) + self.n, 0x20, np.uint8)
        place = np.arange(len(self.bytes)) + np.repeat(np.arange(self.n), np.diff(self.begins))
        spaced[place] = self.bytes
        body = spaced[np.repeat(self.begins[at] + at, sizes) + ragged_arange(sizes)]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())


def _slices(batch: pa.RecordBatch) -> Iterator[Slice]:
    for rows, data, offsets in text_slices(batch, "text", SLICE):
        sizes = np.diff(offsets)
        ended = np.full(len(data) + len(sizes), 0x0A, np.uint8)  # a line's end behind each text
        ended[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
        yield Slice(rows.column(0).cast(pa.string()), ended, offsets + np.arange(len(offsets)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(keys)
    return distinct, np.bincount(codes, counts, len(distinct)).astype(np.int64)


def _hash_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for batch in batches:
        for s in _slices(batch):
            one, two = s.keys()
            keys = np.concatenate([one, two[~s.last]])
            held.append(_summed(keys, np.ones(len(keys))))
            if sum(len(k) for k, _ in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield out(*held.pop())
    if held:
        yield out(*merged())


def frequent_bits(docs: DataFrame, least: int, bits: int = BITS) -> np.ndarray:
    """A map of ``bits`` bits: those of hashes of words and pairs that occur ``least`` times are set, and, by chance, of few others."""
    sums = docs.select("lang", "text").mapInArrow(_hash_sums, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    at = F.pmod("key", F.lit(bits)) + 1
    maps = sums.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map"))
    out = np.zeros((bits // 8 + 4095) // 4096 * 4096, np.uint8)
    for r in maps.collect():  # bits / 8 bytes
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def _grams(bits: int, known, longest: int):
    def has(keys: np.ndarray) -> np.ndarray:
        at = (keys.view(np.int64) % bits).astype(np.int64)
        return known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch):
                if not s.n:
                    continue
                one, two = s.keys()
                ends = np.flatnonzero(s.last | ~has(two))
                at = np.flatnonzero(has(one))
                size = np.minimum(ends[np.searchsorted(ends, at)] - at + 1, longest)
                ids = s.words().dictionary_encode()
                more, word = len(ids.dictionary) + 1, ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                code, distinct = pd.factorize(s.lang[at] * more + word[at])
                total, longer = len(distinct), np.flatnonzero(size > 1)
                part = code[longer].astype(np.int64)
                for k in range(1, longest):  # exact: a number for each distinct beginning, then for it and the next word
                    goes = size[longer] > k
                    part = pd.factorize(part * more + np.where(goes, word[np.minimum(at[longer] + k, s.n - 1)] + 1, 0))[0].astype(np.int64)
                code[longer] = total + part
                code, distinct = pd.factorize(code)
                first = np.empty(len(distinct), np.int64)
                first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
                chosen = at[first]
                totals = np.bincount(s.lang, minlength=len(s.langs))
                there = np.flatnonzero(totals)
                langs = pa.array(s.langs, pa.string()).take(pa.array(np.concatenate([s.lang[chosen], there])))
                phrases = pa.concat_arrays([s.texts(chosen, size[first]), pa.array([""] * len(there), pa.string())])
                sizes = np.concatenate([size[first], np.zeros(len(there), np.int64)])
                counts = np.concatenate([np.bincount(code, minlength=len(distinct)), totals[there]])
                yield pa.RecordBatch.from_arrays([langs, pa.array(sizes, pa.int32()), phrases, pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "n"])

    return run


def edges(docs: DataFrame, work: Workspace, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """(lang, words, phrase, n): counts of edges (``longest`` words) and of piece ends (fewer), cut where no phrase that occurs ``least`` times lies; 0 words: all words of the language."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_bits(docs, least, bits))
    rows = docs.select("lang", "text").mapInArrow(_grams(bits, known, longest), "lang string, words int, phrase string, n long")
    return work.table(rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")), "edges")


def _first(k: int):
    return F.substring_index("phrase", " ", k)


def counts(graph: DataFrame, work: Workspace, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of 1 to ``longest`` words that occur ``least`` times, by the flow through their nodes."""
    level, found = None, []
    for k in range(longest, 0, -1):
        here = graph.where(F.col("words") == k).select("lang", "phrase", "n")
        if level is not None:
            flow = level.select("lang", _first(k).alias("phrase"), "n")
            here = here.unionByName(flow).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = work.table(here, f"level-{k}")
        found.append(level.where(F.col("n") >= least).select("lang", F.lit(k).alias("words"), "phrase", "n"))
    return reduce(DataFrame.unionByName, found)


def taken_up(known: DataFrame) -> DataFrame:
    """(lang, phrase, n): phrases all of whose flow goes through a phrase of one word more."""
    longer = known.where("words > 2")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    return longer.select("lang", inner.alias("phrase"), "n")


def collocations(docs: DataFrame, work: Workspace, least: int = LEAST, longest: int = LONGEST, best: int = BEST, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of 2 to ``longest`` words."""
    graph = edges(docs, work, least, longest, bits)
    known = work.table(counts(graph, work, least, longest), "known")
    work.drop(*[f"level-{k}" for k in range(1, longest + 1)])
    left = known.where("words > 1").join(taken_up(known), ["lang", "phrase", "n"], "left_anti")
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", "substring_index(phrase, ' ', k) AS one", "substring_index(phrase, ' ', k - words) AS two")
    of = lambda name, value: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    totals = graph.where("words = 0").select("lang", "n")
    both = cuts.join(of("one", "l"), ["lang", "one"]).join(of("two", "r"), ["lang", "two"]).join(totals, "lang")
    both = both.withColumn("score", F.expr("(CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"))
    weakest = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*").drop("k")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = weakest.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def paths(graph: DataFrame, work: Workspace, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, n, words, phrase): maximal chains of edges that occur ``least`` times and have one count, as whole passages.

    Between two edges of a chain lies a node whose whole flow comes by the one and goes by the other. A chain never closes
    to a ring, as texts are finite: where they enter it, a node has more flow than its edge brings. So the edges' ways back
    to their chain's first one are found by doubling, a number of joins that grows with the logarithm of the longest chain.
    """
    known = work.table(counts(graph, work, least, longest), "known")
    edge = known.where(F.col("words") == longest).select("lang", F.col("phrase").alias("e"), "n")
    node = known.where(F.col("words") == longest - 1).select("lang", F.col("phrase").alias("v"), "n")
    into = edge.withColumn("v", F.substring_index("e", " ", 1 - longest)).join(node, ["lang", "v", "n"])
    out = edge.select("lang", F.col("e").alias("next"), "n", F.substring_index("e", " ", longest - 1).alias("v")).join(node, ["lang", "v", "n"])
    links = into.join(out, ["lang", "v", "n"]).select("lang", F.col("next").alias("e"), F.col("e").alias("back"))
    # back: an edge ``steps`` before, null at the chain's first one, which is then in ``head``
    start = edge.join(links, ["lang", "e"], "left").select("lang", "e", "n", "back", F.col("back").isNotNull().cast("long").alias("steps"), F.when(F.col("back").isNull(), F.col("e")).alias("head"))
    way, turn = work.table(start, "way-0"), 0
    while not way.where("back IS NOT NULL").isEmpty():
        further = way.select("lang", F.col("e").alias("back"), F.col("back").alias("far"), F.col("steps").alias("more"), F.col("head").alias("there"))
        turn += 1
        moved = way.join(further, ["lang", "back"], "left").select("lang", "e", "n", F.col("far").alias("back"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("head", "there").alias("head"))
        way = work.table(moved, f"way-{turn}")
    chains = way.groupBy("lang", "head").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("steps", F.substring_index("e", " ", -1).alias("w")))).alias("rest"))
    tail = F.array_join(F.slice(F.col("rest.w"), F.lit(2), F.size("rest")), " ")
    return chains.select("lang", "n", (F.size("rest") + longest - 1).alias("words"), F.concat_ws(" ", "head", F.when(F.size("rest") > 1, tail)).alias("phrase"))


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs, Workspace(docs.sparkSession, "phrases"))


ORACLE_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM split GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
counts AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
    FROM starts CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range(1, {LONGEST + 1})) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
inner_phrases AS (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[: k - 1], ' '), array_to_string(string_split(phrase, ' ')[2 :], ' ')]) AS phrase FROM counts WHERE k > 2),
kept AS (SELECT * FROM counts WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = counts.lang AND i.phrase = counts.phrase AND i.f = counts.f)),
cuts AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM kept),
scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, cut, (1000 * a * n) // (x.f * y.f) AS score FROM cuts c
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[: cut], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ') JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {BEST}
"""

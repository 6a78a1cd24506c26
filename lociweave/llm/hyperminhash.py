"""Near-duplicate documents by HyperMinHash: compressed registers, bands, corrected estimates, exact confirmation.

A document's set holds its distinct word shingles as 64-bit hashes. Each shingle falls into
one of ``REGISTERS`` buckets; a bucket keeps its smallest hash as a leading-zero count and
mantissa bits in one byte. Empty buckets take another bucket's register, chosen alike in all
documents, so that two registers agree with the probability of the sets' similarity, for
small sets too. Bands of registers name candidate groups; two texts of similarity 0.8 share
none of the bands with probability (1 - 0.8**5)**40, about 1e-7.

Links, without a pair for each two members of a group:

1. Documents of one and the same set form a class; its smallest id stands for it.
2. In each group of a band, every member is compared with the smallest one (a star).
3. Components of these links. A group that lies in one component needs no more work.
4. In the other groups, members of different components are compared in blocks inside a
   task: by registers first, then on their whole sets; what connects two components is kept.
   A component that fills groups is met once with all strangers in them, not group by group.
5. Components of all links.

Each link is confirmed on full sets of 64-bit hashes; no group is capped or sampled.
The tables between the steps lie in the shared folder as Parquet. Nothing is collected.

Defined results: null or empty texts have an empty set, link with nothing and are kept.
Rows of one set of shingles are one class, named by its smallest doc_id; where rows with that
id name several classes, these are one, and the row with the smallest hash of its text is
compared for it. ``n_shingles`` and the class are each row's own. A null doc_id is in no component (null ids) and kept. A doc_id is a whole number, or a text
of one; others end with Spark's cast error. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, NOT_SPACE, mix, word_hashes
from .work import Workspace, text_slices

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Bits of a register: leading zeros of the smallest hash, then the bits that follow.
ZERO_BITS, MANTISSA_BITS = 4, 4
#: Members of those that meet, and bytes of their sets, that meet in one task in step 4, as one side of a block.
BLOCK_MEMBERS, BLOCK_SETS = 1024, 32_000_000
#: Standard errors of an estimate that a pair may lie under the threshold and still be confirmed on sets.
SLACK = 6.0
#: Members of a block whose sets are held against one set at a time.
TOGETHER = 64

_NEXT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' sorted distinct shingle hashes one after another, and where each set begins (one more at the end)."""
    words, first = word_hashes(data, offsets, NOT_SPACE)
    counts = np.diff(first)
    n_shingles = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    total = int(n_shingles.sum())
    docs = np.repeat(np.arange(len(counts)), n_shingles)
    ends = np.cumsum(n_shingles)
    at = np.arange(total) - np.repeat(ends - n_shingles, n_shingles) + np.repeat(first[:-1], n_shingles)
    limit = np.repeat(first[1:], n_shingles)
    hashes = np.zeros(total, np.uint64)
    for k in range(size):
        inside = at + k < limit  # a document with fewer words is one shingle of all of them
        part = np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(0)) if total else hashes
        hashes = mix(hashes * np.uint64(3) + part + np.uint64(k + 1))
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(total, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(counts) + 1))


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of registers (uint8) for each set; rows of empty sets are zero and mean nothing."""
    n = len(first) - 1
    mixed = mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    bucket = ((mixed >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    cell = np.repeat(np.arange(n), np.diff(first)) * REGISTERS + bucket.astype(np.int64)
    least = np.full(n * REGISTERS, 1 << 32, np.uint64)
    np.minimum.at(least, cell, mix(mixed) >> np.uint64(32))
    least = least.reshape(n, REGISTERS)
    filled = least < (1 << 32)
    small = np.minimum(least, (1 << 32) - 1).astype(np.float64) + 0.5
    exponent = np.frexp(small)[1]
    zeros = np.minimum(32 - exponent, (1 << ZERO_BITS) - 1)
    mantissa = ((small / np.exp2(exponent - 1.0) - 1.0) * (1 << MANTISSA_BITS)).astype(np.int64)
    out = np.where(filled, (zeros << MANTISSA_BITS) | mantissa, 0).astype(np.uint8)
    rows, columns = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = np.uint64(0)
    while len(rows):
        attempt += np.uint64(1)
        other = (mix(columns.astype(np.uint64) * _NEXT + attempt) % np.uint64(REGISTERS)).astype(np.int64)
        found = filled[rows, other]
        out[rows[found], columns[found]] = out[rows[found], other[found]]
        rows, columns = rows[~found], columns[~found]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)) * _NEXT
    for k in range(ROWS):
        key = mix(key * np.uint64(257) + regs.reshape(-1, BANDS, ROWS)[:, :, k])
    return key.view(np.int64)


def zero_levels(n: np.ndarray) -> np.ndarray:
    """For sets of these sizes, the share of registers at each count of leading zeros."""
    load = np.maximum(1.0, np.asarray(n, float) / REGISTERS)[..., None]
    above = (1 - np.exp2(-np.arange(1 << ZERO_BITS))) ** load  # no hash of the bucket has so many leading zeros
    return np.diff(np.concatenate([above, np.ones_like(load)], axis=-1), axis=-1)


def chance_matches(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The share of registers that agree by chance between unlike sets of these sizes: equal leading zeros, then equal mantissas."""
    return (zero_levels(n_a) * zero_levels(n_b)).sum(axis=-1) / (1 << MANTISSA_BITS)


def estimate(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, chance: np.ndarray | None = None) -> np.ndarray:
    """Jaccard similarity from the number of agreeing registers, corrected for chance collisions."""
    chance = chance_matches(n_a, n_b) if chance is None else chance
    return (agree / REGISTERS - chance) / (1 - chance)


def worth_confirming(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, chance: np.ndarray | None = None) -> np.ndarray:
    """False only where sizes rule a link out, or the estimate lies ``SLACK`` standard errors under the threshold.

    Few distinct hashes make many equal registers, so the error follows the smaller of the set's and the registers' number.
    """
    n = np.minimum(REGISTERS, np.minimum(n_a, n_b))
    error = np.sqrt(threshold * (1 - threshold) / np.maximum(n, 1)) * np.where(n < REGISTERS, 1.5, 1.0)
    sizes = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    return sizes & (estimate(agree, n_a, n_b, chance) >= threshold - SLACK * error)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                hashes, first = shingle_sets(data, offsets, size)
                counts = np.diff(first)
                regs = registers(hashes, first)
                totals = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(hashes, out=totals[0, 1:])
                np.cumsum(mix(hashes + _NEXT), out=totals[1, 1:])
                sums = totals[:, first[1:]] - totals[:, first[:-1]]  # of a set, in any order
                keys = band_keys(regs)
                empty = pa.array(counts == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(2),
                        pa.array(counts.astype(np.int64)),
                        pa.array(mix(sums[0]).view(np.int64), mask=np.asarray(empty)),
                        pa.array(mix(sums[1]).view(np.int64), mask=np.asarray(empty)),
                        pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * BANDS, keys.ravel()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                hashes, first = shingle_sets(data, offsets, size)
                raw, regs = hashes.tobytes(), registers(hashes, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "regs", "hashes"],
                )

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows in runs of equal ``keys``, which the batches are sorted by."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (key := tuple(row[k] for k in keys)) != at:
                if rows:
                    yield at, rows
                at, rows = key, []
            rows.append(row)
    if rows:
        yield at, rows


def _confirm_stars(percent: int):
    """Rows sorted by (center, chunk, is_member): each chunk begins with its center's own set; members come one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own, own_regs = None, None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                hashes, regs = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["regs"], np.uint8)
                if not row["is_member"]:
                    center, own, own_regs = row["center"], hashes, regs
                elif center == row["center"]:
                    agree, n_a, n_b = np.count_nonzero(own_regs == regs), np.array([len(own)]), np.array([len(hashes)])
                    if worth_confirming(np.array([agree]), n_a, n_b, percent / 100)[0] and linked(own, hashes, percent):
                        found.append((row["doc"], center))
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def block_links(rows: list[dict], left: int, right: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect all components of one block that links connect: left members with right ones, by registers, then on sets."""
    regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint8).reshape(-1, REGISTERS)
    hashes = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
    sizes = np.array([len(r["hashes"]) // 8 for r in rows])
    first = np.cumsum(sizes) - sizes
    levels = zero_levels(sizes)
    ids = [r["doc"] for r in rows]
    side = np.array([r["part"] for r in rows])
    values, member_of, counts = np.unique([r["component"] for r in rows], return_inverse=True, return_counts=True)
    root = np.arange(len(values))  # of each component
    largest = np.argmax(counts) if left == right else -1  # its pairs are met from the other components' side
    open_ = side == right
    found = []
    for i in np.flatnonzero((side == left) & (member_of != largest)):
        others = np.flatnonzero(open_ & (root[member_of] != root[member_of[i]]))
        agree = (regs[others] == regs[i]).sum(axis=1, dtype=np.int16)
        chance = levels[others] @ levels[i] / (1 << MANTISSA_BITS)
        likely = worth_confirming(agree, sizes[i], sizes[others], percent / 100, chance)
        likely = others[likely][np.argsort(-agree[likely], kind="stable")]
        own = hashes[first[i] : first[i] + sizes[i]]
        while len(likely):
            now, likely = likely[:TOGETHER], likely[TOGETHER:]
            theirs = np.concatenate([hashes[first[j] : first[j] + sizes[j]] for j in now])
            same = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(same, np.cumsum(sizes[now]) - sizes[now], dtype=np.int64)
            for j in now[100 * both >= percent * (sizes[i] + sizes[now] - both)]:
                a, b = sorted((root[member_of[i]], root[member_of[j]]))
                if a != b:
                    root[root == b] = a
                    found.append((ids[i], ids[j]))
            likely = likely[root[member_of[likely]] != root[member_of[i]]]
        if left == right:
            open_[i] = False  # all its pairs have been met
    return found


def meetings(parts: DataFrame, first: DataFrame) -> DataFrame:
    """(of_crowd, key, doc, size, component, few): who are to be compared, from groups parts(key, doc, size, component) and first(doc, component).

    Only groups of more than one component are kept, and of those with the same members one. A group's crowd is the component
    with most members in it, the others are its few. Where a group has half of its crowd's component or more, which at most
    twice ``BANDS`` groups can, and no more few than that, the crowd is met under the component's name: it comes once for all these groups, with all their few,
    and that is at most twice the comparisons. The few of such a group meet under its key, as all of another group do.
    """
    held = parts.withColumns({"h": F.xxhash64("doc"), "h2": F.xxhash64("doc", F.lit(1))}).groupBy("key", "component")
    held = held.agg(F.count("*").alias("c"), F.bit_xor("h").alias("h"), F.bit_xor("h2").alias("h2"))
    groups = held.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("several"), F.sum("c").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("h2").alias("h2"))
    groups = groups.where("several > 1").groupBy("top", "several", "n", "h", "h2").agg(F.min("key").alias("key"))
    sizes = first.groupBy("component").agg((F.count("*") + 1).alias("all"))  # the one that names it is not in ``first``
    groups = groups.select("key", "several", "n", F.col("top.c").alias("c"), F.col("top.component").alias("crowd")).join(sizes.withColumnRenamed("component", "crowd"), "crowd", "left")
    groups = groups.select("key", "several", "crowd", (2 * F.col("c") >= F.greatest("n", F.coalesce("all", F.lit(1)))).alias("of_crowd"))
    rows = parts.join(groups, "key").withColumn("few", F.col("component") != F.col("crowd"))
    by_key = rows.where("NOT of_crowd OR (few AND several > 2)").select(F.lit(False).alias("of_crowd"), "key", "doc", "size", "component", "few")
    by_crowd = rows.where("of_crowd").select(F.lit(True).alias("of_crowd"), F.col("crowd").alias("key"), "doc", "size", "component", "few")
    return by_key.union(by_crowd.distinct())


def dealt(met: DataFrame) -> DataFrame:
    """(of_crowd, key, left, right, doc, component, part): the rows of ``meetings`` for each block that they lie in.

    All that fit into one block are there together. Else the few are dealt to blocks and the crowd to others; the few's meet each
    other's, but for those under a component's name, and the crowd's. A crowd's own never meet.
    """
    blocks = lambda n, total: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(8 * total / BLOCK_SETS)).cast("int")
    many = ~F.col("few")
    side = lambda own: (F.count(F.when(own, 1)), F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)))
    counts = met.groupBy("of_crowd", "key").agg(
        blocks(F.count("*"), F.sum("size")).alias("all"), F.greatest(F.lit(1), blocks(*side(F.col("few")))).alias("a"), blocks(*side(many)).alias("b")
    )
    deal = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    part = F.when(F.col("all") == 1, 0).when(F.col("few"), deal(F.col("a"))).otherwise(F.col("a") + deal(F.greatest(F.lit(1), F.col("b"))))
    rows = met.join(counts, ["of_crowd", "key"]).withColumn("part", part)
    others = F.when(many, F.sequence(F.lit(0), F.col("a") - 1)).otherwise(F.sequence(F.when(F.col("of_crowd"), F.col("a")).otherwise(0), F.col("a") + F.col("b") - 1))
    other = F.explode(F.when(F.col("all") == 1, F.array(F.lit(0))).otherwise(others)).alias("other")
    return rows.select("of_crowd", "key", "doc", "component", "part", other).select(
        "of_crowd", "key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "doc", "component", "part"
    )


def _confirm_blocks(percent: int):
    """Rows of one (of_crowd, key, left, right) block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, left, right), rows in _runs(batches, ("of_crowd", "key", "left", "right")):
            if found := block_links(rows, left, right, percent):
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(doc, component): the smallest id that each linked document reaches, by alternating large and small stars."""
    edges = work.table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, step = now, step + 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("u > m").select("u", F.col("m").alias("v"))
        large = work.table(large.union(own).where("u <> v").distinct(), f"{name}-{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = work.table(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step}-large", f"{name}-{step - 1}")
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; kept: the smallest id of its component."""
    spark = docs.sparkSession
    work = Workspace(spark, "hyperminhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    signed = work.table(
        hashed.mapInArrow(_signatures(words), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures"
    )
    same = ["set_a", "set_b", "n_shingles"]
    # 1. classes of equal sets
    some = signed.where("n_shingles > 0")
    classes = work.table(some.groupBy(*same).agg(F.min("doc_id").alias("doc")).where("doc IS NOT NULL"), "classes")
    heads = some.join(classes, same).where("doc_id = doc").groupBy("doc").agg(F.min(F.struct("text_hash", "n_shingles", "bands")).alias("head"))
    bands = heads.select("doc", "head.text_hash", F.col("head.n_shingles").alias("size"), F.explode("head.bands").alias("key"))
    # 2. stars
    groups = work.table(bands.groupBy("key").agg(F.min("doc").alias("center"), F.count("*").alias("n")).where("n > 1"), "groups")
    members = work.table(bands.join(groups, "key"), "members")
    wanted = members.select(F.col("doc").alias("doc_id"), "text_hash").distinct()
    chosen = hashed.join(wanted, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    sets = work.table(chosen.mapInArrow(_sets(words), "doc_id long, regs binary, hashes binary"), "sets")
    pairs = members.where("doc <> center").select("doc", "center").distinct()
    stars = work.table(_confirmed(pairs, sets, percent), "stars")
    # 3. groups that lie in more than one component
    first = components(work, stars, "first")
    of = members.where("n > 2").join(first, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    of = work.table(of.select("key", "doc", "size", "component"), "parts")
    # 4. blocks of those groups
    met = work.table(meetings(of, first), "met")
    full = dealt(met).join(sets.withColumnRenamed("doc_id", "doc"), "doc")
    block = ["of_crowd", "key", "left", "right"]
    full = full.repartition(*block).sortWithinPartitions(*block, "doc")
    more = work.table(full.mapInArrow(_confirm_blocks(percent), "u long, v long"), "more")
    # 5. all links
    final = components(work, stars.union(more), "final")
    work.drop("groups", "members", "sets", "stars", "parts", "met", "more")
    ids = classes.join(final, "doc", "left").select(*same, F.coalesce("component", "doc").alias("component"))
    out = signed.select("doc_id", *same).join(ids, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, chunk: int = 256) -> DataFrame:
    """Links (u, v) among ``pairs`` (doc, center), confirmed on full sets. A center's members go in chunks, each with the center's set."""
    chunks = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / chunk)).cast("int")
    counts = pairs.groupBy("center").agg(F.count("*").alias("n"))
    dealt = pairs.join(counts, "center").withColumn("chunk", chunks).select("center", "chunk", "doc", F.lit(True).alias("is_member"))
    own = counts.select("center", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1)).alias("chunk"), F.col("center").alias("doc"), F.lit(False).alias("is_member"))
    rows = dealt.union(own).join(sets.withColumnRenamed("doc_id", "doc"), "doc")
    rows = rows.repartition("center", "chunk").sortWithinPartitions("center", "chunk", "is_member")
    return rows.mapInArrow(_confirm_stars(percent), "u long, v long")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=2)

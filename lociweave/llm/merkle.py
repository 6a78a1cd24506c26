"""Merkle manifest of a dataset, and proofs of all its rows by octopus multiproofs.

A row's leaf is a hash of its fields. The leaves of a source, in ascending doc_id order, are
hashed in runs of ``ARITY`` level by level to the source's root, and the sources' roots, in
source order, to the root of the dataset.

1. Leaves are hashed by built-in functions where the texts lie; texts are never shuffled.
2. Leaves are dealt by range of (source, doc_id) and packed into blocks, a row of the table
   ``blocks`` for each ``BLOCK`` leaves at most. Sums of counts over blocks give every
   block's place in its sources and every source's rank, so no source, however many leaves it
   has, meets in one task.
3. A block hashes all nodes that lie under its own leaves and gives those that no such node
   covers: at most ``2 * (ARITY - 1)`` for each level and source border. The nodes over
   several blocks are grouped level by level, a job for each level.
4. Octopus multiproof: a block's leaves need, of each level, the siblings of their ancestors;
   those that the block cannot derive itself are the runs' ends left and right of its own
   interval. This smallest union of coordinates is computed from the block's place alone,
   fetched by one join, and within a task the shared interior nodes are derived from it once
   and every leaf's own proof is read off. The root that a block derives so does not come
   from step 3, which it is held against.

Defined results: a null field is hashed as ``-``, so null and empty differ. Null sources and
null doc_ids come first; equal doc_ids of a source are ordered by leaf, and repeated rows are
leaves of their own. A row without doc_id is never taken for changed by the query. Columns
beside the hashed fields are ignored. An empty table has no root and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from .work import Workspace

#: Fields of a leaf, in order; the first orders the leaves of a source, the second names the source.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, SHIFT = 16, 4
#: Leaves of a block, and leaves that a range of the table should hold where the session's number of partitions is too small.
BLOCK, RANGE_LEAVES = 16_384, 262_144
#: The tree over sources, among the sources' own trees 0, 1, ...
TOP = -1

NODE = "tree long, level int, idx long, n long, digest string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(digests: list[str]) -> str:
    """Hash of digests as hexadecimal text, one after another."""
    return sha256("".join(digests).encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """Hash of the fields: ``-`` for null, else the value's byte count, a colon and the value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass(frozen=True)
class Manifest:
    """blocks(part, seq, n, ids, leaves, others, changed, sources, counts), places(part, seq, k, source, tree, before, count, n), nodes(tree, level, idx, n, digest), the root and the number of sources."""

    blocks: DataFrame
    places: DataFrame
    nodes: DataFrame
    root: str | None
    n_sources: int

    def sources(self) -> DataFrame:
        """(source, n_leaves, subroot)."""
        tops = self.nodes.where((F.col("tree") != TOP) & (_size(F.col("n"), F.col("level")) == 1)).select("tree", F.col("digest").alias("subroot"))
        return self.places.where("before = 0").select("source", F.col("n").alias("n_leaves"), "tree").join(tops, "tree").drop("tree")


def _size(n: Column, level: Column | int) -> Column:
    """Nodes of a level of a tree over ``n`` leaves."""
    return F.call_function("shiftright", n - 1, (level * SHIFT if isinstance(level, Column) else F.lit(level * SHIFT)).cast("int")) + 1


def _blocks(size: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            source = rows.column("source").combine_chunks()
            runs = pc.run_end_encode(source)
            ends = runs.run_ends.to_pylist()
            counts = [b - a for a, b in zip([0, *ends], ends, strict=False)]
            other = rows.column("other")
            join = lambda c: b"".join(c.drop_null().to_pylist())
            columns = {
                "part": (part, pa.int32()), "seq": (seq, pa.int32()), "n": (len(rows), pa.int32()), "ids": (rows.column("id").to_pylist(), pa.list_(id_type)),
                "leaves": (join(rows.column("leaf")), pa.binary()), "others": (join(other), pa.binary()), "changed": (bytes(other.is_valid().to_pylist()), pa.binary()),
                "sources": (runs.values.to_pylist(), pa.list_(pa.string())), "counts": (counts, pa.list_(pa.int32())),
            }
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns.values()], names=list(columns))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, size))
                held, n, seq = rows.slice(size).to_batches(), n - size, seq + 1
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _places(blocks: DataFrame) -> DataFrame:
    """A row for each source of each block: the source's rank ``tree``, its leaves before this block, here, and in all."""
    rows = blocks.select("part", "seq", F.posexplode(F.arrays_zip("sources", "counts")).alias("k", "x")).select("part", "seq", "k", F.col("x.sources").alias("source"), F.col("x.counts").cast("long").alias("count"))
    of = W.partitionBy("source")
    before = F.coalesce(F.sum("count").over(of.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("n", F.sum("count").over(of)).withColumn("first", (F.col("before") == 0).cast("long"))
    parts = rows.groupBy("part").agg(F.sum("first").alias("begun"))
    parts = parts.select("part", F.coalesce(F.sum("begun").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begun"))  # a row for each range
    own = F.sum("first").over(W.partitionBy("part").orderBy("seq", "k"))
    return rows.withColumn("own", own).join(parts, "part").select("part", "seq", "k", "source", (F.col("begun") + F.col("own") - 1).alias("tree"), "before", "count", "n")


def uncovered(digests: list[str], first: int, n: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes under which only these leaves, the ``first``-th and following of ``n``, lie, without those under another such node."""
    level = 0
    while digests:
        size, end = ((n - 1) >> SHIFT * level) + 1, first + len(digests)
        low, high = -(-first // ARITY), -(-size // ARITY) if end == size else end // ARITY  # runs that lie here as a whole
        if size == 1 or high <= low:
            yield from ((level, first + k, d) for k, d in enumerate(digests))
            return
        inside = range(ARITY * low - first, min(ARITY * high, end) - first)
        yield from ((level, first + k, d) for k, d in enumerate(digests) if k not in inside)
        digests = [hashed(digests[k : min(k + ARITY, inside.stop)]) for k in inside[::ARITY]]
        first, level = low, level + 1


def _hex(data: bytes) -> list[str]:
    text = data.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def _frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            leaves, at, found = _hex(row["leaves"]), 0, []
            for p in row["places"]:
                found += [(p["tree"], level, idx, p["n"], d) for level, idx, d in uncovered(leaves[at : at + p["count"]], p["before"], p["n"])]
                at += p["count"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in NODE.split(", ")])


def _with_places(blocks: DataFrame, places: DataFrame) -> DataFrame:
    own = places.groupBy("part", "seq").agg(F.sort_array(F.collect_list(F.struct("k", "tree", "before", "count", "n"))).alias("places"))  # at most a row for each leaf of a block
    return blocks.join(own, ["part", "seq"])


def _grown(work: Workspace, nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """``nodes`` and those over them, a table for each level of the largest tree."""
    found, level = [nodes], 0
    while (largest - 1) >> SHIFT * level:
        here = nodes.where(F.col("level") == level)
        here = here.unionByName(found[-1].where(F.col("level") == level)) if level else here
        parent = F.call_function("shiftright", F.col("idx"), F.lit(SHIFT))
        runs = here.where(_size(F.col("n"), level) > 1).groupBy("tree", "n", parent.alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # ARITY nodes at most
        whole = F.size("run") == F.least(F.lit(ARITY), _size(F.col("n"), level) - F.col("idx") * ARITY)
        digest = F.when(whole, F.sha2(F.array_join(F.col("run.digest"), ""), 256)).otherwise(F.raise_error(F.lit("a node of the tree is missing")).cast("string"))
        level += 1
        found.append(work.table(runs.select("tree", F.lit(level).alias("level"), "idx", "n", digest.alias("digest")), f"{name}-{level}"))
    return found


def build(docs: DataFrame, work: Workspace, other: Column | None = None, fields: tuple[str, ...] = FIELDS, block: int = BLOCK) -> Manifest:
    """The manifest of ``docs``. ``other``: another leaf of a row to prove in place of its own, null for none."""
    spark, (key, source, *_) = docs.sparkSession, fields
    own = leaf({f: F.col(f) for f in fields})
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(key).alias("id"), F.unhex(own).alias("leaf"), (F.unhex(other) if other is not None else F.lit(None).cast("binary")).alias("other"))
    leaves = work.table(rows, "leaves")
    n = leaves.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_LEAVES))
    # equal rows may lie in any order, so their place in the table deals them to several ranges
    dealt = leaves.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, "source", "id", "leaf", "place").sortWithinPartitions("source", "id", "leaf")
    id_type = docs.schema[key].dataType
    schema = f"part int, seq int, n int, ids array<{id_type.simpleString()}>, leaves binary, others binary, changed binary, sources array<string>, counts array<int>"
    blocks = work.table(dealt.drop("place").mapInArrow(_blocks(block, to_arrow_type(id_type)), schema), "blocks")
    work.drop("leaves")
    places = work.table(_places(blocks), "places")
    sizes = places.agg(F.max("n").alias("n"), F.max("tree").alias("tree")).first()
    if sizes["n"] is None:
        return Manifest(blocks, places, spark.createDataFrame([], NODE), None, 0)
    trees = _grown(work, work.table(_with_places(blocks.select("part", "seq", "leaves"), places).mapInArrow(_frontier, NODE), "frontier"), sizes["n"], "level")
    below = trees[0]
    for t in trees[1:]:
        below = below.unionByName(t)
    count = sizes["tree"] + 1
    subroots = below.where(_size(F.col("n"), F.col("level")) == 1)
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "digest")
    above = _grown(work, work.table(tops, "subroots"), count, "top")
    root = above[-1].where(_size(F.col("n"), F.col("level")) == 1).first()["digest"]
    nodes = below
    for t in above:
        nodes = nodes.unionByName(t)
    return Manifest(blocks, places, nodes, root, count)


def missing(m: Manifest) -> DataFrame:
    """(part, seq, tree, level, idx): the smallest union of nodes with which each block proves all its leaves."""
    here = m.places.where("before > 0 OR count < n").select("part", "seq", "tree", F.col("before").alias("a"), (F.col("before") + F.col("count") - 1).alias("e"), "n")
    ranks = m.places.groupBy("part", "seq").agg(F.min("tree").alias("a"), F.max("tree").alias("e"))
    above = ranks.select("part", "seq", F.lit(TOP).cast("long").alias("tree"), "a", "e", F.lit(m.n_sources).cast("long").alias("n"))
    levels = F.expr(f"explode(filter(sequence(0, {63 // SHIFT}), l -> shiftright(n - 1, {SHIFT} * l) > 0))")
    rows = here.unionByName(above).withColumn("level", levels).withColumn("bits", F.col("level") * SHIFT)
    rows = rows.selectExpr("part", "seq", "tree", "level", "shiftright(a, bits) AS a", "shiftright(e, bits) AS e", "shiftright(n - 1, bits) + 1 AS size")
    rows = rows.selectExpr("*", f"a - a % {ARITY} AS low", f"least(size, e - e % {ARITY} + {ARITY}) AS high")
    none = "CAST(array() AS ARRAY<BIGINT>)"
    idx = f"explode(concat(if(a > low, sequence(low, a - 1), {none}), if(high > e + 1, sequence(e + 1, high - 1), {none}))) AS idx"
    return rows.selectExpr("part", "seq", "tree", "level", idx)


class Tree:
    """One tree as a block sees it: of each level the runs over its own leaves, from own and fetched nodes."""

    def __init__(self, digests: list[str], first: int, n: int, fetched: dict[tuple[int, int], str]):
        self.runs, self.low = [], []
        level = 0
        while (size := ((n - 1) >> SHIFT * level) + 1) > 1:
            end = first + len(digests)
            low, high = first - first % ARITY, min(size, -(-end // ARITY) * ARITY)
            whole = [*[fetched[level, k] for k in range(low, first)], *digests, *[fetched[level, k] for k in range(end, high)]]
            self.runs.append([whole[k : k + ARITY] for k in range(0, len(whole), ARITY)])
            self.low.append(low // ARITY)
            digests, first, level = [hashed(r) for r in self.runs[-1]], low // ARITY, level + 1
        self.root = digests[0]

    def run(self, level: int, idx: int) -> list[str]:
        """The run of a node."""
        return self.runs[level][(idx >> SHIFT) - self.low[level]]

    def siblings(self, idx: int, level: int = 0) -> Iterator[list[str]]:
        """The siblings of a leaf's ancestors, from ``level`` on; ``idx`` is the ancestor there."""
        for k in range(level, len(self.runs)):
            run, at = self.run(k, idx), idx % ARITY
            yield run[:at] + run[at + 1 :]
            idx >>= SHIFT

    def fold(self, idx: int, digest: str) -> str:
        """The root with ``digest`` in place of a leaf."""
        for k in range(len(self.runs)):
            run, at = self.run(k, idx), idx % ARITY
            digest = hashed([*run[:at], digest, *run[at + 1 :]])
            idx >>= SHIFT
        return digest


def folded(digest: str, slots: list[int], siblings: list[list[str]]) -> str:
    """The root by a proof: of each level the place among the siblings, and these."""
    for at, run in zip(slots, siblings, strict=True):
        digest = hashed([*run[:at], digest, *run[at:]])
    return digest


def _proved(make: Callable, names: list[str]):
    """Output rows of blocks: ``make`` gets a block's row, its trees by source, their places and the tree over sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fetched: dict[int, dict] = {}
                for x in row["fetched"] or ():
                    if x["digest"] is None:
                        raise RuntimeError(f"no node {x['level']}, {x['idx']} of tree {x['tree']}")
                    fetched.setdefault(x["tree"], {})[x["level"], x["idx"]] = x["digest"]
                leaves, at, trees = _hex(row["leaves"]), 0, []
                for p in row["places"]:
                    trees.append(Tree(leaves[at : at + p["count"]], p["before"], p["n"], fetched.get(p["tree"], {})))
                    at += p["count"]
                top = Tree([t.root for t in trees], row["places"][0]["tree"], row["n_sources"], fetched.get(TOP, {}))
                columns = make(row, leaves, trees, top)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], batch.schema.field("ids").type.value_type), *columns], names=names)

    return run


def _others(row: dict) -> Iterator[str | None]:
    others = iter(_hex(row["others"]))
    return (next(others) if x else None for x in row["changed"])


def _digests(root: str):
    def make(row: dict, leaves: list[str], trees: list[Tree], top: Tree) -> list[pa.Array]:
        subroots, proofs, roots, others = [], [], [], _others(row)
        for p, tree in zip(row["places"], trees, strict=True):
            above = "".join("".join(x) for x in top.siblings(p["tree"])).encode()
            subroots += [tree.root] * p["count"]
            run, own, suffix = -1, [], above
            for k in range(p["before"], p["before"] + p["count"]):
                if tree.runs and k >> SHIFT != run:  # a run's leaves share all but their first siblings
                    run, own = k >> SHIFT, tree.run(0, k)
                    suffix = "".join("".join(x) for x in tree.siblings(run, 1)).encode() + above
                j = k % ARITY
                proofs.append(sha256("".join(own[:j] + own[j + 1 :]).encode() + suffix).hexdigest())
                changed = next(others)
                roots.append(top.root if changed is None else top.fold(p["tree"], tree.fold(k, changed)))
        return [*[pa.array(x, pa.string()) for x in (leaves, subroots, [root] * len(leaves), proofs, roots)], pa.array([r == root for r in roots], pa.bool_())]

    return make


def _explicit(root: str):
    def make(row: dict, leaves: list[str], trees: list[Tree], top: Tree) -> list[pa.Array]:
        slots, siblings = [], []
        for p, tree in zip(row["places"], trees, strict=True):
            above = list(top.siblings(p["tree"]))
            for k in range(p["before"], p["before"] + p["count"]):
                siblings.append([*tree.siblings(k), *above])
                slots.append([*[k >> SHIFT * x & ARITY - 1 for x in range(len(tree.runs))], *[p["tree"] >> SHIFT * x & ARITY - 1 for x in range(len(top.runs))]])
        return [pa.array(leaves), pa.array([root] * len(leaves)), pa.array(slots, pa.list_(pa.int32())), pa.array(siblings, pa.list_(pa.list_(pa.string())))]

    return make


def _map(m: Manifest, make: Callable, columns: str, key: str) -> DataFrame:
    id_type = m.blocks.schema["ids"].dataType.elementType
    schema = f"`{key}` {id_type.simpleString()}, {columns}"
    if m.root is None:
        return m.blocks.sparkSession.createDataFrame([], schema)
    wanted = missing(m).join(m.nodes.drop("n"), ["tree", "level", "idx"], "left")
    fetched = wanted.groupBy("part", "seq").agg(F.collect_list(F.struct("tree", "level", "idx", "digest")).alias("fetched"))
    rows = _with_places(m.blocks.drop("sources", "counts", "n"), m.places).join(fetched, ["part", "seq"], "left").withColumn("n_sources", F.lit(m.n_sources))
    return rows.mapInArrow(_proved(make, [key, *[x.split()[0] for x in columns.split(", ")]]), schema)


def proofs(m: Manifest, key: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, root, slots, siblings): of each level the leaf's place in its run and the run's other nodes; ``folded`` checks them."""
    return _map(m, _explicit(m.root), "leaf string, root string, slots array<int>, siblings array<array<string>>", key)


def checked(m: Manifest, key: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof as a digest, and whether its leaf, or its other leaf, leads to the root."""
    return _map(m, _digests(m.root), "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", key)


def query(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, with a fifth of the texts changed to lower case."""
    work = Workspace(docs.sparkSession, "merkle")
    fields = {f: F.col(f) for f in FIELDS}
    changed = leaf(fields | {"text": F.translate("text", _UPPER, _LOWER)})
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    return checked(build(docs, work, other))


def _sql_leaf(fields: list[str]) -> str:
    one = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(one.format(f) for f in fields) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (
    SELECT i, i, 0 FROM range(256) AS t(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT documents.*, row_number() OVER () AS r,
    CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda x: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(x AS INT), 1)) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]))) % 5 = 0 ELSE false END AS hit
    FROM documents CROSS JOIN crc),
leaves AS (SELECT r, doc_id, source, hit, {_sql_leaf(list(FIELDS))} AS leaf, {_sql_leaf([f if f != "text" else f"translate(text, '{_UPPER}', '{_LOWER}')" for f in FIELDS])} AS other FROM docs),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(tree, n, level, idx, digest) AS (
    SELECT tree, n, 0, pos, leaf FROM placed UNION ALL
    SELECT tree, (n + 15) // 16, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY 1, 2, 3, 4),
subroots AS (SELECT tree, digest AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(n, level, idx, digest) AS (
    SELECT n, 0, tree, subroot FROM subroots UNION ALL
    SELECT (n + 15) // 16, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY 1, 2, 3),
root AS (SELECT digest AS root FROM tops WHERE n = 1),
sides AS (
    SELECT r, 0 AS upper, level, idx, digest FROM placed p JOIN nodes d ON d.tree = p.tree AND d.n > 1 AND d.idx >> 4 = p.pos >> (4 * level + 4) UNION ALL
    SELECT r, 1, level, idx, digest FROM placed p JOIN tops d ON d.n > 1 AND d.idx >> 4 = p.tree >> (4 * level + 4)),
steps AS (
    SELECT r, upper, level, row_number() OVER (PARTITION BY r ORDER BY upper, level) AS step,
        string_agg(digest, '' ORDER BY idx) FILTER (idx < own) AS left_of, string_agg(digest, '' ORDER BY idx) FILTER (idx > own) AS right_of
    FROM (SELECT s.*, (CASE WHEN upper = 0 THEN pos ELSE tree END) >> (4 * level) AS own FROM sides s JOIN placed USING (r)) GROUP BY r, upper, level),
folds(r, step, digest) AS (
    SELECT r, 0, CASE WHEN hit THEN other ELSE leaf END FROM placed UNION ALL
    SELECT r, s.step, sha256(coalesce(left_of, '') || digest || coalesce(right_of, '')) FROM folds f JOIN steps s USING (r) WHERE s.step = f.step + 1),
last AS (SELECT r, arg_max(digest, step) AS folded_root FROM folds GROUP BY r),
sums AS (SELECT r, sha256(string_agg(coalesce(left_of, '') || coalesce(right_of, ''), '' ORDER BY step)) AS proof FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN last USING (r) LEFT JOIN sums USING (r) CROSS JOIN root
"""


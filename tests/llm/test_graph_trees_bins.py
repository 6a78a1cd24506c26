"""Residual packing, Merkle proofs and phrase graphs against brute force, with nulls, ties, empties, repeated rows and odd columns."""

import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lociweave.llm import merkle, phrase_graph, residual_packing
from lociweave.llm.work import Workspace

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()
ODD = [None, "", " ", "\n\n", "one", "a  b\n\n c", "ÄÖ ﬁ  x", "é" * 50, "word " * 9000, "\tTab\r\nline ", "don't stop, x's. 3.14"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


# residual packing


@pytest.mark.parametrize("options", [{}, {"part_items": 20, "fan_in": 2, "residuals": 5}])
def test_residual_packing_round_trip(spark, options):
    r = random.Random(1)
    texts = [*ODD, *[prose(k, r.choice([1, 5, 50, 400, 1500, 2600])) for k in range(90)], *["same text"] * 30]
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string, piece long")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = residual_packing.pack(docs, path, **options).collect()
    plain = Tokenizer.from_file(path)
    want = Counter()
    for d, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for p, start in enumerate(range(0, len(ids), 4096)):
            part = array("I", ids[start : start + 4096])
            want[d, p, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * r["length"] else "<u4").astype("<u4").tobytes()) == r["ids_crc32"]
    total = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    # as few sequences as one best fit over all pieces leaves, or within one in twenty in the smallest parts
    alone = len(residual_packing.best_fit(np.array([k[3] for k in want.elements()]), 4096)[2])
    assert len(by) <= (alone if not options else alone * 1.05 + 1)


def test_residual_packing_of_nothing_and_of_text_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert residual_packing.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r["doc_id"] for r in residual_packing.pack(spark.createDataFrame([("a1", "x")], "doc_id string, text string"), path).collect()] == ["a1"]


@pytest.mark.parametrize("case", ["mixed", "halves", "equal", "ones"])
def test_best_fit_by_brute_force(case):
    rng = np.random.default_rng(3)
    lengths = {"mixed": rng.integers(1, 101, 400), "halves": np.tile([50, 51], 100), "equal": np.full(90, 33), "ones": np.ones(250, int)}[case]
    bins, places, held = residual_packing.best_fit(lengths, 100)
    rooms = []
    for size in sorted(lengths.tolist(), reverse=True):
        fits = [x for x in rooms if x >= size]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - size)
    assert sorted((100 - held).tolist()) == sorted(rooms)
    for b in range(len(held)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(places[own])]
        assert (places[own] == np.cumsum(lengths[own]) - lengths[own]).all() and lengths[own].sum() == held[b] <= 100


def test_small_residuals_meet_across_parts(spark):
    """Each part leaves one short sequence; the tree brings them together."""
    work = Workspace(spark, "test")
    items = spark.range(640).select(F.col("id").alias("item"), F.lit(30).cast("int").alias("length"))
    found = residual_packing.assign(items, work, capacity=1000, part_items=10, fan_in=4, residuals=3)
    held = found.groupBy("sequence_id").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in held) == 640 and all(r["n"] <= 33 for r in held)
    assert len(held) <= 1.35 * -(-640 // 33)  # 64 parts of about 10 items would need 64 sequences


# Merkle proofs


def leaf(row):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha256("".join(map(text, row)).encode()).hexdigest()


def tree(leaves):
    """All levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha256("".join(levels[-1][k : k + 16]).encode()).hexdigest() for k in range(0, len(levels[-1]), 16)])
    return levels


def sides(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append((at % 16, level[run:at] + level[at + 1 : run + 16]))
        at //= 16
    return out


def brute_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], low)) if hit else leaf(r), r[0]))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(sources[s])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (*_, own, other, d) in enumerate(sorted(sources[s])):
            steps = [*sides(trees[k], i), *sides(top, k)]
            fold = other
            for at, run in steps:
                fold = sha256("".join([*run[:at], fold, *run[at:]]).encode()).hexdigest()
            out.append((d, own, trees[k][-1][0], top[-1][0], sha256("".join("".join(x) for _, x in steps).encode()).hexdigest(), fold, fold == top[-1][0]))
    return out


def manifest_rows():
    r = random.Random(4)
    rows = [(i, r.choice(["hot"] * 6 + ["ü", "Z", "a", "a b"]), r.choice(["en", None, ""]), r.choice([None, i]), r.choice([None, "", "Text", "ÄB é", "low"])) for i in range(900)]
    rows += [(5, "hot", "en", 1, "Tie"), (5, "hot", "en", 1, "Tie"), (5, "hot", "en", 2, "tie"), (None, "hot", None, None, None), (None, None, None, None, "No Id"), (7, None, "x", 3, "N"), (-12, "", "", 0, "Minus")]
    return rows + [(k, f"single{k:04d}", "en", k, f"One {k}") for k in range(300)] + [(3000, "same", "en", 1, "Same")] * 40


@pytest.mark.parametrize("block", [7, 64, 16_384])
def test_manifest_by_brute_force(spark, block):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    m = merkle.build(docs, Workspace(spark, "test"), F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf({f: F.col(f) for f in merkle.FIELDS} | {"text": F.translate("text", merkle._UPPER, merkle._LOWER)})), block=block)
    key = lambda r: tuple(map(str, r))
    want = sorted(brute_manifest(rows), key=key)
    assert sorted((tuple(r) for r in merkle.checked(m).collect()), key=key) == want
    assert {r["subroot"] for r in m.sources().collect()} == {w[2] for w in want} and m.sources().count() == len({r[1] for r in rows})
    for r in merkle.proofs(m).collect():
        assert merkle.folded(r["leaf"], r["slots"], r["siblings"]) == r["root"] == m.root
    # no block fetches what it can derive, nor a node twice
    assert merkle.missing(m).count() == merkle.missing(m).distinct().count()
    if block == 16_384:
        return
    widest = merkle.missing(m).groupBy("part", "seq", "tree", "level").count().agg(F.max("count")).first()[0]
    assert widest <= 2 * (merkle.ARITY - 1)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted(tuple(r) for r in merkle.query(docs).collect())
    assert got == sorted(brute_manifest(rows)) if n else got == []


def test_manifest_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "s", "en", 1, "x"), ("a", "s", "en", 1, "x")], "doc_id string, source string, lang string, n_chars long, text string")
    m = merkle.build(docs, Workspace(spark, "test"))
    assert m.root == tree([leaf(("a", "s", "en", 1, "x")), leaf(("b", "s", "en", 1, "x"))])[-1][0]


def test_a_changed_text_does_not_verify(spark):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    wrong = {r["doc_id"] for r in merkle.query(docs).where("NOT verified").collect()}
    assert wrong == {k for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 0}


# phrase graph


def brute_counts(rows, longest=5):
    """(lang, phrase words): count; words of each language."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        f[lang or "und", tuple(w[i : i + k])] += 1
    return f, n


def brute_phrases(rows, least, best):
    f, n = brute_counts(rows)
    good = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), b in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if b >= f[lang, w[i : i + k]]:
                    dropped.add((lang, w[i : i + k]))
    found = defaultdict(list)
    for (lang, w), a in good.items():
        if (lang, w) not in dropped:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:best]))


def phrase_rows():
    r = random.Random(6)
    words = ["a", "b", "c", "A", "É", "é", "x-y", "'t", "longer-word-than-twenty-four-bytes", " ", "0"]
    rows = [(r.choice(["en", "en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(r.randint(0, 60)))) for _ in range(150)]
    passage = " ".join(f"p{k}" for k in range(70))
    rows += [("en", f"{passage}. q"), ("en", f"before {passage}"), ("en", passage), ("en", "z z z z z z z z z z z z")]
    return rows + [("en", t) for t in ODD] + [("fr", None), ("fr", ""), (None, " ; ")] + [("de", "the same row again")] * 12


@pytest.mark.parametrize(("least", "best", "bits"), [(3, 2000, phrase_graph.BITS), (2, 7, phrase_graph.BITS), (4, 50, 1 << 15), (1, 100_000, 1 << 15)])
def test_collocations_by_brute_force(spark, monkeypatch, least, best, bits):
    monkeypatch.setattr(phrase_graph, "SLICE", 700)
    rows = phrase_rows()
    docs = spark.createDataFrame([(k % 5, lang, t, "x") for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")
    work = Workspace(spark, "test")
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = phrase_graph.collocations(docs, work, least, best=best, bits=bits)
    assert got.columns == list(columns)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, best)


def test_node_flow_gives_all_counts(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    work = Workspace(spark, "test")
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in phrase_graph.counts(phrase_graph.edges(docs, work, 2), work, 2).collect()}
    assert got == {k: v for k, v in brute_counts(rows)[0].items() if v >= 2}


def test_paths_are_whole_repeated_passages(spark):
    rows = phrase_rows()
    work = Workspace(spark, "test")
    got = {(r["lang"], r["phrase"]): (r["n"], r["words"]) for r in phrase_graph.paths(phrase_graph.edges(spark.createDataFrame(rows, "lang string, text string"), work, 3), work, 3).collect()}
    f, _ = brute_counts(rows)
    edge = {x: a for x, a in f.items() if len(x[1]) == 5 and a >= 3}
    after = {}  # the edge that carries on all of an edge's flow
    for (lang, w), a in edge.items():
        for (other, v), b in edge.items():
            if lang == other and w[1:] == v[:-1] and a == b == f[lang, w[1:]]:
                after[lang, w] = (lang, v)
    want = {}
    for x in set(edge) - set(after.values()):
        words, at = list(x[1]), x
        while at in after:
            at = after[at]
            words.append(at[1][-1])
        want[x[0], " ".join(words)] = (edge[x], len(words))
    assert got == want and ("en", " ".join(f"p{k}" for k in range(70))) in got


def test_collocations_of_nothing(spark):
    for rows in ([], [("en", None)]):
        assert phrase_graph.query(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_scores_past_64_bits(spark):
    work = Workspace(spark, "test")
    big = 9 * 10**12
    graph = spark.createDataFrame([("en", 0, "", 10**14), ("en", 2, "x y", big), ("en", 1, "y", 5)], "lang string, words int, phrase string, n long")
    with pytest.MonkeyPatch.context() as p:
        p.setattr(phrase_graph, "edges", lambda *a: graph)
        row = phrase_graph.collocations(None or spark.createDataFrame([], "lang string, text string"), work, least=1).collect()[0]
    assert row["score"] == 1000 * big * 10**14 // (big * 5)

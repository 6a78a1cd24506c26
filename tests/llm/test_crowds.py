"""Who meets whom in step 4 of near duplicates: every pair of a group and of two components, and a crowd's members once, not group by group."""

import random
from collections import defaultdict

import pytest

from lociweave.llm import hyperminhash

PARTS = "key long, doc long, size long, component long"


def first_of(spark, rows):
    docs = {(d, c) for _, d, _, c in rows if d != c}
    return spark.createDataFrame(sorted(docs), "doc long, component long")


@pytest.mark.parametrize("members", [3, 1024])
def test_every_pair_of_two_components_meets(spark, monkeypatch, members):
    monkeypatch.setattr(hyperminhash, "BLOCK_MEMBERS", members)
    r = random.Random(5)
    component = {d: 0 if d < 30 else 30 + (d - 30) // 4 * 4 if d < 50 else d for d in range(70)}
    groups = {k: r.sample(range(30), r.choice([0, 3, 20, 28])) + r.sample(range(30, 70), r.choice([1, 3, 9])) for k in range(40)}
    groups[40] = groups[0]
    rows = [(k, d, 10, component[d]) for k, docs in groups.items() for d in docs]
    met = hyperminhash.meetings(spark.createDataFrame(rows, PARTS), first_of(spark, rows))
    blocks = defaultdict(list)
    for x in hyperminhash.dealt(met).collect():
        blocks[x["of_crowd"], x["key"], x["left"], x["right"]].append((x["doc"], x["part"]))
    pairs = set()
    for (_, _, left, right), docs in blocks.items():
        assert len(docs) == len(set(docs)) and {p for _, p in docs} <= {left, right}
        pairs |= {(a, b) for a, p in docs for b, q in docs if p == left and q == right}
    pairs |= {(b, a) for a, b in pairs}
    assert {(a, b) for docs in groups.values() for a in docs for b in docs if component[a] != component[b]} <= pairs


def test_a_crowd_comes_once_for_all_its_groups(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK_MEMBERS", 100)
    rows = [(k, d, 10, 0) for k in range(40) for d in range(1000) if (d + 25 * k) % 1000 < 900]
    rows += [(k, 1000 + k % 20 * 2 + x, 10, 1000 + k % 20 * 2 + x) for k in range(40) for x in range(2)]
    got = hyperminhash.dealt(hyperminhash.meetings(spark.createDataFrame(rows, PARTS), first_of(spark, rows))).count()
    assert got <= 1000 + 40 * 12 + 80  # by groups: 40 times 902, and that for each of ten blocks


def test_near_duplicates_of_crowds_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK_MEMBERS", 4)
    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 7)):
            copy[r.randrange(60)] = f"x{r.randrange(400)}"
        texts.append(copy)
    sets = [set(zip(t, t[1:], strict=False)) for t in texts]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in hyperminhash.near_duplicates(df, words=2).collect()}
    assert 1 < len(set(root)) < 60 and [got[i] for i in range(60)] == root

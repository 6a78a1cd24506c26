"""Single tokens and documents read from stored token files, against whole-text encoding."""

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lociweave.llm import token_files
from lociweave.llm.work import Workspace

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_take_is_every_single_token():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes = token_files.Codes(token_files.encode(ids))
        at = rng.integers(0, n, 3 * n) if n else np.zeros(0, int)
        np.testing.assert_array_equal(codes.take(at), ids[at])
        assert [codes[int(i)] for i in at[:50]] == ids[at[:50]].tolist()
        with pytest.raises(IndexError):
            codes.take(np.array([n]))


def test_tokens_and_documents_from_the_stored_files(spark):
    """Nulls, empty texts, repeated and missing ids, a document longer than a shard, positions outside."""
    rng = np.random.default_rng(1)
    words = ["alpha", "Ωmega", "42", "end\n", "a-b", "日本"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "again seven"), (None, "no id"), (90, None), (91, ""), (92, "long text " * 900)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    work = Workspace(spark, "stored")
    shards = token_files.write_tokens(docs, work, PATH, 0, 300)
    tokenizer = Tokenizer.from_file(PATH)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    own = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ordered]
    flat = np.concatenate([x for _, x in own])
    starts = np.cumsum([0] + [len(x) for _, x in own])[:-1]
    assert shards.count() > 5

    asked = [int(x) for x in rng.integers(0, len(flat), 200)] + [0, 0, len(flat) - 1, len(flat), -1, None]
    got = token_files.tokens_at(shards, spark.createDataFrame([(p,) for p in asked], "position long"), 300).collect()
    assert sorted((r["position"], r["id"]) for r in got) == sorted((p, int(flat[p])) for p in {p for p in asked if p is not None and 0 <= p < len(flat)})

    chosen = [3, 7, 7, 90, 91, 92, None, 1000]
    got = token_files.documents(shards, spark.createDataFrame([(i,) for i in chosen], "doc_id long")).collect()
    want = [(i, int(s), len(x), x) for (i, x), s in zip(own, starts, strict=True) if i in chosen]
    assert sorted(map(str, ((r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in got))) == sorted(map(str, want)) and len(want) == 7

    nothing = token_files.write_tokens(docs.limit(0), Workspace(spark, "stored"), PATH)
    assert token_files.tokens_at(nothing, spark.createDataFrame([(0,)], "position long")).count() == 0
    assert token_files.documents(nothing, docs).count() == 0
    # the codes lie in the file as they are
    file = shards.inputFiles()[0].removeprefix("file:").replace("///", "/")
    meta = pq.ParquetFile(file).metadata.row_group(0)
    assert {meta.column(c).compression for c in range(meta.num_columns)} == {"UNCOMPRESSED"}
    codes = pq.read_table(file, columns=["codes"]).column(0)[0].as_py()
    assert codes in open(file, "rb").read()

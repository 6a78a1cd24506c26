"""Corpus operators against brute force, exact round trips and held-out accuracy, with nulls, ties, empties and odd columns."""

import hashlib
import os
import random
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lociweave.llm import chat_format, decontaminate, html_blocks, hyperminhash, packing, quality_rules, rule_ensemble, secret_scan, token_counts, token_files, tokens
from lociweave.llm.work import Workspace

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def frame(spark, texts):
    """Documents with columns that clash with the operators' own names."""
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, kept long")


ODD = [None, "", " ", "\n\n", "one", "a  b\n\n c", "ÄÖ ﬁ  x", "é" * 50, "word " * 3000, "\tTab\r\nline ", "don't stop, x's. 3.14"]


def test_quality_rules(spark):
    texts = [*ODD, prose(1, 80), prose(1, 80), "the same three words " * 20, "\n".join(["a line of the text"] * 9 + ["another line of it"])]
    got = {r["doc_id"]: r for r in quality_rules.query(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)} if len(words) < 500 else set(range(len(words)))
        assert got[i]["n_words"] == len(words) and got[i]["word_chars"] == sum(map(len, words)) and got[i]["n_repeat_words"] == len(covered)
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.query(frame(spark, [])).count() == 0


def test_token_codes_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 200), np.zeros(700)]).astype(np.uint32)
    codes = token_files.Codes(token_files.encode(ids))
    assert (codes.all() == ids).all() and all(codes[i] == ids[i] for i in range(0, len(ids), 7))
    assert len(token_files.Codes(token_files.encode(ids[:0])).all()) == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_have_the_ids_of_whole_texts(name):
    texts = [t or "" for t in ODD] + [prose(2, 50), " lead", "a \n b", "x<|endoftext|> y", "a​b", "ab, cd., (e.) ''s ..", "1 2  3 ½", "ΑΣ ΣΑΣ."]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    encoder = tokens.Encoder(public_tokenizers.path(name))
    assert encoder.layout == {"byte_bpe_50k.json": "kept", "word_bpe_49k.json": "dropped"}[name]
    for _ in range(2):
        assert encode(encoder, texts) == want
    unknown = tokens.Encoder(public_tokenizers.path(name))
    unknown.odd = None  # a tokenizer of other rules: all texts are encoded whole
    assert encode(unknown, texts) == want


def encode(encoder, texts):
    """Each text's ids as bytes."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, at = encoder.ids(pa.array(texts, pa.string()), np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_have_the_ids_of_whole_texts(name):
    r = random.Random(5)
    parts = ["a", "B", "é", "Σ", "ﬁ", "'", "'s", ".", ",", "1", "²", "½", "-", "_", "\u0301", "\u0338", "=", "中", "\u1100", "\u1161", "\0", "\x1c", "\t", "\u2009", "<|", "|>", "end", "don", "word", "x" * 30, "\N{GRINNING FACE}"]
    texts = ["".join(r.choice([*parts, " ", " ", "\n"]) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [array("I", e.ids).tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder(public_tokenizers.path(name))
    assert encode(encoder, texts) == want
    spans = token_counts.SpanEncoder(public_tokenizers.path(name))
    raw = [t.encode() for t in texts]
    rows, counts = spans.rows(pa.array(texts), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert list(map(tuple, rows.tolist())) == [s for e in plain.encode_batch(texts, add_special_tokens=False) for s in e.offsets]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    texts = [*ODD, prose(8, 40).replace("7 ", "7.\n\n"), "x\n", "\n\n\ny", "é\n中文\n\n  z"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {}
    for r in token_counts.count_tokens(frame(spark, texts), path, rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["end"], r["n_tokens"], r["n_crossing"])
    plain = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        text = text or ""
        spans = plain.encode(text, add_special_tokens=False).offsets
        edges = [0, *[k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)], len(text)]
        want = [[a, b, 0, 0] for a, b in zip(edges, edges[1:])]
        for a, b in spans:
            share = [max(0, min(b, y) - max(a, x)) for x, y, _, _ in want]
            inside = [k for k, v in enumerate(share) if v]
            owner = {"first": inside[0], "last": inside[-1], "most": share.index(max(share))}[rule]
            want[owner][2] += 1
            want[inside[0]][3] += len(inside) > 1
        assert [list(got[i][k]) for k in sorted(got[i])] == want
    assert token_counts.query(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_given_sections_and_fields(spark, rule):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, r = Tokenizer.from_file(path), random.Random(3)
    texts = [None, "", "one two three", prose(4, 30), prose(4, 30), "intercontinental  ballistic\n\n misunderstanding " * 4]
    sections = [(2, "all", 0, 13), (2, "none", 5, 5), (5, "x", 3, 40), (5, "y", 20, 33), (9, "lost", 0, 5)]
    for i in (3, 4):
        cuts = sorted(r.sample(range(len(texts[i])), 9))
        sections += [(i, f"s{k}", a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if k % 3]
    table = spark.createDataFrame(sections, "doc_id long, name string, start long, end long")
    got = {}
    for x in token_counts.count_tokens(token_counts.with_sections(frame(spark, texts), table), path, rule, sections="sections").collect():
        got.setdefault(x["doc_id"], {})[x["name"]] = (x["n_tokens"], x["n_crossing"])
    for i, text in enumerate(texts):
        own = sorted((a, b, n) for d, n, a, b in sections if d == i)
        own = [(a, min(b, own[k + 1][0]) if k + 1 < len(own) else b, n) for k, (a, b, n) in enumerate(own)]
        want = {n: [0, 0] for _, _, n in own} | {None: [0, 0]}
        for a, b in plain.encode(text or "", add_special_tokens=False).offsets:
            share = [max(0, min(b, y) - max(a, x)) for x, y, _ in own]
            inside = [k for k, v in enumerate(share) if v]
            if not inside:
                want[None][0] += 1
                continue
            owner = {"first": inside[0], "last": inside[-1], "most": share.index(max(share))}[rule]
            want[own[owner][2]][0] += 1
            want[own[inside[0]][2]][1] += len(inside) > 1
        assert got.get(i, {}) == {n: tuple(v) for n, v in want.items() if n is not None or v[0]}
    fields = spark.createDataFrame([(1, "A title", None, "The body of it."), (1, "A title", None, "The body of it.")], "doc_id long, title string, `a.b` string, text string")
    rows = token_counts.count_tokens(token_counts.with_fields(fields, ["title", "a.b", "text"]), path, rule, sections="sections").collect()
    assert sorted((x["name"] or "", x["n_tokens"]) for x in rows) == [("", 3)] * 2 + [("a.b", 0)] * 2 + [("text", 5)] * 2 + [("title", 2)] * 2


def test_token_files(spark):
    texts = [*ODD, prose(3, 60)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    work = Workspace(spark, "test-tokens")
    got = token_files.read_tokens(token_files.write_tokens(frame(spark, texts), work, path, shard_tokens=50)).orderBy("doc_id").collect()
    plain, start = Tokenizer.from_file(path), 0
    for i, text in enumerate(texts):
        ids = array("I", plain.encode(text or "", add_special_tokens=False).ids + [0])
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.query(frame(spark, [])).count() == 0


def test_packing(spark):
    texts = [*ODD, *[prose(k, 40 * k) for k in range(1, 30)]]
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(frame(spark, texts), path, length=256, step=4).collect()
    plain = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r["start"], r["length"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert [x for _, _, b in mine for x in np.frombuffer(b, "<u2")] == ids
        assert [s for s, _, _ in mine] == list(np.cumsum([0] + [n for _, n, _ in mine])[:-1])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(by) <= 1.12 * total / 256 + 1
    assert packing.query(frame(spark, [])).count() == 0


def test_column_generation_covers_all():
    demand = np.array([5, 0, 9, 1, 0, 7, 3, 2])
    plan = packing.solve(demand, 8)
    assert (sum(t * c for t, c in plan) >= demand).all()
    assert all((c * np.arange(1, 9)).sum() <= 8 for _, c in plan)
    assert sum(t for t, _ in plan) <= int(np.ceil((demand * np.arange(1, 9)).sum() / 8)) + 2


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>"
        "<div class=ad>Buy it now.</div><article><h1>Caf&eacute; &amp; more</h1><p>First  para\ngraph of the text, which is long enough.<p><b>Second one<br>with a break.</p></article>"
        "<section class='comments'><p>A reader says so.</p></section><footer>&copy; someone</footer></body></html>"
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p", "x"), (5, "u", page, "x")]
    got = {r["page_id"]: r for r in html_blocks.query(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    want = "Café & more\nFirst para graph of the text, which is long enough.\nSecond one with a break."
    assert got[1]["text"] == got[5]["text"] == want and got[1]["n_chars"] == len(want)
    assert [got[k]["text"] for k in (2, 3, 4)] == ["", "", ""]


def test_html_raw_text_and_unclosed_elements():
    def texts(body):
        return [b.text for b in html_blocks.blocks(f"<html><body>{body}</body></html>")]

    kept = "<article><p>Kept.</p></article>"
    hidden = [
        "<script>for(i=0;i<n;i++){f()}</script>", "<SCRIPT>if(a<b&&c)x='\"'</Script >", "<style>a<b{}</style>", "<textarea>1 <b or</textarea>", "<noscript>x <y </noscript>", "<iframe>i<n</iframe>",
        "<script><!-- d.write('<script>a</script>'); x<y --></script>", "<script><!--></script>", "<script src=a />x</script>",
        "<svg><svg><text>in</text></svg><text>out</text></svg>", "<svg><style/><text>in</text></svg>", "<object><object>in</object>out</object>", "<object><script>'</object>'</script>in</object>", "<canvas>a<canvas>b</canvas>c</canvas>",
        "<template><p>in<template>x</template>out</p></template>", "<select><option>a<option>b</select>",
        "<select><option>a<option>b", "<form><select><option>a</form>", "<object>o", "<canvas>c", "<svg><text>s</text>", "<select><option>a<p></p><select><option>b</select>",
    ]
    for x in hidden:
        assert texts(x + kept) == ["Kept."], x
        assert texts("<p>Before.</p>" + x + kept + "<p>After.</p>") == ["Before.", "Kept.", "After."], x
    for x in hidden[:16]:
        assert texts(f"<p>a{x}b</p>") == ["a", "b"], x
    assert texts("<p>a</p><script>i<n") == ["a"]
    assert [b.path for b in html_blocks.blocks("<select><option>a<article>x")] == [("article",)]


def test_html_quotes_and_odd_markup():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<article><p title=it's>Hello world</p><p>we don't stop</p><p>last</p></article>") == ["Hello world", "we don't stop", "last"]
    assert texts("""<body><script>x='<a b="';</script><p>Text "q" here</p><p>more</p></body>""") == ['Text "q" here', "more"]
    assert texts("""<body><script>if(a<b && s=='"'){f()}</script><p>Text one</p><p>more</p></body>""") == ["Text one", "more"]
    assert texts("""<p a = "x > y" b='>' c=d"e>one</p><p a=">two</p>three""") == ["one", "two", "three"]
    assert texts("""<p data-x="it's" "stray" 'one>a</p><img alt="5 > 3">b""") == ["a", "b"]


def test_html_long_pages_take_linear_time_and_bounded_memory():
    import time
    import tracemalloc

    labeller = html_blocks.trained()
    began = time.time()
    deep = html_blocks.blocks("<div class='a b'>x " * 100_000)
    nested = html_blocks.blocks("<ul><li><a href=x><b>" * 20_000 + "</a>y" * 20_000)
    assert len(deep) == 100_000 and len(deep[-1].path) == 3 and nested
    assert time.time() - began < 30
    tracemalloc.start()
    own = [html_blocks.blocks("<p>one two three</p>" * 30_000), *[html_blocks.blocks("<p>a</p>" * 3)] * 127]
    probabilities = labeller.label(own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(p) for p in probabilities] == [len(p) for p in own] and peak < 250e6


def test_html_of_ever_new_wrappers_and_unclosed_cells():
    import time
    import tracemalloc

    labeller = html_blocks.trained()
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    pages = ["".join(f"<div class=x{name(k)}>t" for k in range(20_000)), "<td><ul>" + "<b>" * 20_000 + "<td>x</td>" * 20_000]
    for page, n in zip(pages, (20_000, 20_000)):
        tracemalloc.start()
        began = time.time()
        own = html_blocks.blocks(page)
        assert [len(p) for p in labeller.label([own])] == [len(own)] == [n]
        assert time.time() - began < 90 and tracemalloc.get_traced_memory()[1] < 150e6
        tracemalloc.stop()
    assert len(html_blocks.blocks(pages[0])[-1].path) == 20_001


def test_path_sums_are_those_of_whole_paths():
    pages, _ = html_blocks.generated_pages(30, seed=5)
    labeller = html_blocks.Labeller()
    assert np.allclose(labeller._described(pages), labeller._rows(html_blocks.describe(pages)), rtol=0, atol=1e-12)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="needs the given pages")
def test_html_of_whole_given_pages_by_their_article_element():
    """Every given page marks its article, which the labeller does not know to trust: its blocks, cut out by a parser of its own, are the text."""
    import html.parser

    import pyarrow.parquet as pq

    class Article(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("article", "p", "h1"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1"):
                self.blocks.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    found = [html_blocks.blocks(p) for p in pages]
    right = 0
    for page, own, p in zip(pages, found, html_blocks.trained().label(found)):
        parser = Article()
        parser.feed(page)
        parser.close()
        want = [t for b in parser.blocks if (t := " ".join(b.split()))]
        right += [b.text for b, x in zip(own, p) if x >= 0.5] == want
    assert right >= 249 and len(pages) == 250  # of one page a paragraph of one word is missed


def test_labels_do_not_depend_on_the_batch():
    pages, _ = html_blocks.generated_pages(40, seed=77)
    labeller = html_blocks.trained()
    together, alone = labeller.label(pages), [labeller.label([p])[0] for p in pages]
    assert all(np.allclose(a, b) for a, b in zip(together, alone, strict=True))
    counts = np.array([len(p) for p in pages])
    z = labeller._forward(html_blocks.describe(pages), counts)[-1]  # as in training
    assert np.allclose(np.concatenate(together), 1 / (1 + np.exp(-z)))


def test_html_deep_wrappers(spark):
    def page(outer, inner):
        text = "".join(f"<p>Sentence {k} of the text, which is long enough to be one.</p>" for k in range(4))
        return (
            "<html><head><title>T</title><script>for(i=0;i<n;i++){f()}</script></head><body>" + outer * 20 + "<nav class='menu'><ul><li><a href='/a'>Home</a></li></ul></nav>"
            "<article class='content'>" + inner * 20 + text + "</div>" * 20 * bool(inner) + "</article><div class='comments'>" + inner * 20 + "<p>A reader says so.</p>" + "</div>" * 20 * bool(inner) + "</div>"
            "<footer><p>&copy; someone</p></footer></body></html>"
        )

    wrappers = ["", "<div>", "<div class='outer container row'>"]
    rows = [(i, "u", page(a, b)) for i, (a, b) in enumerate((a, b) for a in wrappers for b in wrappers)]
    want = "\n".join(f"Sentence {k} of the text, which is long enough to be one." for k in range(4))
    assert [r["text"] for r in html_blocks.query(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()] == [want] * len(rows)


def test_labeller_on_pages_it_has_not_seen():
    pages, labels = html_blocks.generated_pages(150, seed=123)
    found = html_blocks.trained().label(pages)
    right = np.concatenate([(p >= 0.5) == np.array(y) for p, y in zip(found, labels, strict=True)])
    assert right.mean() > 0.97


def test_decontamination(spark):
    item = prose(5, 14)
    short = "only four words here"
    bench = spark.createDataFrame([("a", item), ("b", item), ("c", short), ("d", None), ("e", "")], "item_id string, text string")
    words = item.split()
    texts = [None, "", item.upper(), " ".join(words[:9]), "x " + " ".join(words[2:13]) + " y", "say: ONLY four, words here!", prose(6, 400), item + " " + item]
    got = {r["doc_id"]: r for r in decontaminate.query(frame(spark, texts), bench).collect()}
    assert [got[i]["n_hit"] for i in range(8)] == [0, 0, 14, 0, 11, 4, 0, 28]
    assert [got[i]["n_items"] for i in range(8)] == [0, 0, 2, 0, 2, 1, 0, 2]
    assert got[2]["items_sha256"] == hashlib.sha256(b"a,b").hexdigest()
    assert decontaminate.clean(frame(spark, texts), bench).count() == 4
    assert decontaminate.query(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.query(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 100])
def test_decontamination_by_items_without_id(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    a, b = prose(5, 14), prose(6, 14)
    docs, bench = [(0, "x " + a), (1, b), (2, a + " " + b), (3, "none of it"), (4, "four words only here")], [(None, a), (None, "four words only here"), ("b", b), ("c", a + " more")]
    items = spark.createDataFrame(bench, "item_id string, text string")
    got = decontaminate.query(frame(spark, [t for _, t in docs]), items).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(14, 2, True), (14, 1, True), (28, 3, True), (0, 0, False), (4, 1, True)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", bench)
    assert sorted(con.sql(decontaminate.ORACLE_SQL).fetchall()) == [tuple(r) for r in got]
    assert [r["doc_id"] for r in decontaminate.clean(frame(spark, [t for _, t in docs]), items).collect()] == [3]


def test_longest_matches_by_brute_force(spark):
    r = random.Random(7)
    few = lambda n: " ".join(r.choice("a b c".split()) for _ in range(n))
    item = prose(5, 30)
    bench = [("i", item), ("j", few(12)), ("k", few(5)), ("l", "one"), (None, prose(9, 20))]
    long, short = " ".join(item.split()[:30]), " ".join(item.split()[4:24])
    texts = [None, "", long, long, "x " + short, short + " y", "x " + long + " " + short, prose(9, 20), prose(9, 20) + " z", *[few(n) for n in (1, 3, 8, 40, 40)], *[few(25)] * 3, "none"]

    def longest(words):
        have = {tuple(words[i : i + n]) for n in range(1, 31) for i in range(len(words) - n + 1)}
        return max((n for _, t in bench for w in [t.split()] for n in range(1, len(w) + 1) for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in have), default=0)

    docs, items = frame(spark, texts).coalesce(1), spark.createDataFrame(bench, "item_id string, text string")
    got = {x["doc_id"]: x["longest"] for x in decontaminate.matches(docs, items).collect()}
    assert [got[i] for i in range(len(texts))] == [longest((t or "").split()) for t in texts]
    assert (got[2], got[3], got[4], got[5]) == (30, 30, 20, 20)


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 300).astype(np.uint64)
    first = np.array([0, 100, 100, 250, 300])
    ends = np.repeat(first[1:], np.diff(first))
    order, _ = decontaminate.suffix_array(words, ends, 200)
    keys = [tuple(words[p : ends[p]].tolist()) for p in order]
    assert keys == sorted(keys)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|x", "<<SYS>> a <</SYS>>", "", None, "plain"]
    rows = [(k % 2, k, "assistant" if k % 2 else "user", t, "x") for k, t in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(chat_format.canonical_turns(df.drop("turns")))).collect()}
    assert [t["text"] for t in back[0]["turns"]] == [t or "" for t in nasty[::2]]
    assert back[1]["loss_text"] == "".join(t or "" for t in nasty[1::2])
    assert chat_format.query(spark, df).count() == 3


def test_layouts(spark):
    rows = [
        ('{"id":"1","messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', "messages"),
        ('{"id":"2","conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', "shares"),
        ('{"id":"3","prompt":"hi","completion":"yo"}', "prompt"),
        ('{"id":"4","instruction":"hi","input":"","output":"yo"}', "instruction"),
        ('{"z":1}', None), ("not json", None), (None, None),
    ]
    got = chat_format.canonical_json_turns(spark.createDataFrame(rows, "json string, want string").select("json")).collect()
    assert sorted(str(r["layout"]) for r in got) == sorted(str(w) for _, w in rows)
    for r in got:
        if r["layout"]:
            assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "hi"), ("assistant", "yo")]


def test_layouts_by_nested_paths(spark):
    both, user = [("user", "hi"), ("assistant", "yo")], [("user", "hi")]
    rows = [
        ('{"id":"1","messages":[{"speaker":"user","text":"hi"}]}', None, None),
        ('{"id":"2","source":{"x":[1]},"messages":[{"role":"user","content":"hi","t":null},{"content":"yo","role":"assistant"}]}', "messages", both),
        ('{"id":"3","instruction":"hi","output":"yo"}', "instruction", both),
        ('{"id":"4","instruction":"hi","output":"yo","input":null,"n":1.5}', "instruction", both),
        ('{"id":"5","prompt":"hi"}', None, None),
        ('{"id":"6","messages":[]}', "messages", []),
        ('{"id":"7","messages":null}', "messages", []),
        ('{"id":"8","messages":[{"role":"user","content":"hi"},{"speaker":"x","text":"lost"}]}', None, None),
        ('{"id":"9","messages":["hi"]}', None, None),
        ('{"id":"10","conversations":[{"from":"human","value":"hi"}],"a b: `>":{"OBJECT<":[[{"x":1}]]}}', "shares", user),
        ('{"id":"11","conversations":[{"speaker":"human","value":"hi"}]}', None, None),
        ('{"messages":{"role":"user","content":"hi"},"id":"12"}', None, None),
        ("[1]", None, None), ("null", None, None),
    ]
    got = chat_format.canonical_json_turns(spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(rows)], "n int, json string").orderBy("n").coalesce(1)).collect()
    assert [(r["layout"], r["turns"] and [(t["role"], t["text"]) for t in r["turns"]]) for r in got] == [(layout, turns) for _, layout, turns in rows]
    assert [r["conv_id"] for r in got if r["layout"]] == ["2", "3", "4", "6", "7", "10"]
    assert got[0]["fingerprint"] == chat_format.fingerprint(["id", "messages[].speaker", "messages[].text"])
    assert got[9]["fingerprint"] == chat_format.fingerprint(["id", "conversations[].from", "conversations[].value", "a b: `>.OBJECT<[][].x"])
    table = spark.createDataFrame([("3", "hi", "yo", 1)], "id string, instruction string, output string, more int")
    assert [(t["role"], t["text"]) for t in chat_format.canonical_turns(table).first()["turns"]] == both


def test_rule_ensemble_on_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(rule_ensemble.NAMES)))
    y = ((x[:, 2] < 0.7) & (x[:, 4] < 0.8)).astype(float)
    found = rule_ensemble.fit(x[:2400], y[:2400])
    m = rule_ensemble._matrix(x[2400:], list(found.rules)) @ np.array(found.weights) + found.intercept
    assert ((m > 0) == (y[2400:] > 0)).mean() > 0.97
    assert rule_ensemble.fit(x[:0], y[:0]).rules == ()


def test_rule_ensemble_scores_everything(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    rows = rule_ensemble.query(frame(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows}[0] == (zlib.crc32(b"0") % 5 == 0)


def test_secrets(spark):
    key = "AKIA" + "B7" * 8
    texts = [*ODD, f"x {key} y", 'token = "abc"', "Password: s3cret/value é", f"é {'0a' * 12}!", "ghp_a8Fk20xLq93mZp10TyRw77eBn45cVd61HsJu ok"]
    got = {r["doc_id"]: r for r in secret_scan.query(frame(spark, texts)).collect()}
    n = len(ODD)
    assert [got[n + k]["n_assign"] for k in range(4)] == [0, 0, 1, 0] and got[n]["n_access"] == 1 and got[n + 3]["n_hex"] == 1
    assert got[n]["base_sha256"] == hashlib.sha256(f"access:2:{2 + len(key)}".encode()).hexdigest()
    assert got[n + 4]["spans"].startswith("model:")
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame(spark, texts)).collect()}
    assert clean[n] == "x [SECRET] y" and clean[n + 3] == "é [SECRET]!" and clean[n + 2] == "[SECRET] é" and clean[0] is None


def brute_components(texts, size, percent):
    words = [[w for w in (t or "").lower().split()] for t in texts]
    sets = [frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []) for w in words]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    r, texts = random.Random(4), ["", None, "one", "One", "a b", "A  b", "a b c d e f"]
    for g in range(6):
        base = prose(g, 60).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            texts.append(" ".join(copy))
    want, sizes = brute_components(texts, size, 80)
    got = {x["doc_id"]: x for x in hyperminhash.near_duplicates(frame(spark, texts), words=size).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    regs = hyperminhash.registers(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    agree = np.array([(regs[0] == regs[1]).sum()])
    assert hyperminhash.estimate(agree, np.array([1000]), np.array([1000]))[0] == pytest.approx(800 / 1200, abs=0.12)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [f"The {prose(k, 30)} and of the {prose(k + 50, 30)} is in the end." for k in range(12)]
    texts = [*good, good[0] + " again", "bad ### " * 60, None, "the token = 'abcdef123456' " + good[1][5:] + prose(99, 40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", " ".join(good[2].split()[5:25]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept["quality_rules"] == {*range(13), 15}
    assert kept["near_duplicates"] == {*range(12), 15}
    assert kept["decontamination"] == {*range(12), 15} - {2}
    assert docs.where(F.col("text").contains("abcdef123456")).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["secret_scan"]


def test_pipeline_stages_on_odd_names_and_on_nothing(spark, tmp_path):
    """Other columns may have any name, clashing or with dots; an empty table gives no rows; ids of the packed pieces make up the sequences."""
    import corpus_pipeline

    spark.createDataFrame([("i", "a b c")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [f"The {prose(k, 30)} and of the {prose(k + 50, 30)} is in the end." for k in range(3)]
    names = ["x.y", "a`b", "kept", "component_id", "doc_id", "text", "n shingles"]
    for texts in ([], [*good, good[0], None]):
        rows = [(1, 2, 3, 4, i, t, 5) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "`x.y` int, `a``b` int, kept int, component_id int, doc_id long, text string, `n shingles` int")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == names
        assert {tuple(r)[:4] for r in docs.collect()} == ({(1, 2, 3, 4)} if texts else set())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert {r["doc_id"] for r in packed.collect()} == ({0, 1, 2} if texts else set())
        assert packing.sequences(packed).count() == (1 if texts else 0)


CLASHES = "n_words kept _words _row hits items longest spans score at text doc_id n_chars".split()


def clashing(spark, texts):
    """Documents whose other columns have the names that operators use inside."""
    rows = [tuple({"text": t, "doc_id": i, "n_chars": len(t or "")}.get(c, 999 + i) for c in CLASHES) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in CLASHES))


def test_filtering_operators_keep_every_column_as_it_is(spark):
    good = f"The {prose(1, 30)} and of the {prose(2, 30)} is in the end."
    docs = clashing(spark, [good, None, "password = 'abcdef12345' " + good])
    bench = spark.createDataFrame([("a", "nothing of the kind is in there")], "item_id string, text string")
    for out in (quality_rules.keep(docs), decontaminate.clean(docs, bench), secret_scan.redact(docs)):
        assert out.columns == CLASHES
        for r in out.collect():
            i = r["doc_id"]
            assert all(r[c] == 999 + i for c in CLASHES if c not in ("text", "doc_id", "n_chars"))
            assert r["n_chars"] == len(r["text"] or "")
        assert out.limit(0).count() == 0
    scored = rule_ensemble.score(docs, rule_ensemble.fit(np.zeros((0, 12)), np.zeros(0)))
    assert [r["n_words"] for r in scored.orderBy("doc_id").collect()] == [999, 1000, 1001]


def test_secrets_touching_base_spans_and_long_candidates(spark):
    inner = "0123456789abcdef" * 2
    long = "/".join(["services", "alerting", "T024BE7LD", "B0X4K2Q9Z"]) + "/a8Fk20xLq93mZp10TyRw77eB"
    texts = [f"key sk-live-{inner}XYZTail9QwErTy77 end", f"see {long} ok", " ".join(f"token=abcdef{i:08d} k{i:015d}Ab" for i in range(4000))]
    began = __import__("time").time()
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame(spark, texts)).collect()}
    assert __import__("time").time() - began < 60
    assert clean[0] == "key [SECRET] end" and "a8Fk20xLq93mZp10TyRw77eB" not in clean[1]
    assert secret_scan.window_starts(0, 48) == [0] and secret_scan.window_starts(0, 100) == [0, 24, 48, 52]
    assert secret_scan.uncovered([(0, 5), (6, 9), (20, 30)], [("hex", 0, 3), ("hex", 3, 5), ("hex", 7, 9), ("hex", 19, 31)]) == [(6, 9)]


def test_secret_network_on_findings_it_has_not_seen():
    network = secret_scan.trained()
    x, y, finding = secret_scan.labelled_findings(1500, seed=5)
    scores, best = network.scores(x), {}
    for f, mark, s in zip(finding, y, scores):
        best[f] = (mark, max(s, best.get(f, (0, 0))[1]))
    found = np.array([s >= network.threshold for m, s in best.values() if m])
    wrong = np.array([s >= network.threshold for m, s in best.values() if not m])
    assert found.mean() > 0.94 and wrong.mean() < 0.06


def test_base_spans_by_brute_force(spark):
    r, parts = random.Random(8), ["password", "Api_key", "apikey", "TOKEN", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "deadbeef" * 3, "é", "\n", "x-y/z+=", "secret"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(300)]

    def one(pattern, text, least, group=0, fold=False):
        """Matches from the left, none overlapping, tried at each place."""
        import re

        rule, at, out = re.compile(pattern, re.ASCII | (re.IGNORECASE if fold else 0)), 0, []
        while at < len(text):
            if m := rule.match(text, at):
                if len(m[group]) >= least:
                    out.append((at, m.end()))
                at = m.end()
            else:
                at += 1
        return out

    got = {x["doc_id"]: x for x in secret_scan.query(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        kinds = {
            "assign": one(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, 6, 2, True),
            "access": one("AKIA[A-Z0-9]+", t, 20), "hex": one("[0-9a-f]+", t, 24),
        }
        want = sorted((a, k, b) for k, (name, v) in enumerate(kinds.items()) for a, b in v)
        joined = ",".join(f"{list(kinds)[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and [got[i][f"n_{k}"] for k in kinds] == [len(v) for v in kinds.values()]


def test_long_benchmark_items_take_memory_in_proportion():
    import tracemalloc

    item = prose(1, 40_000)
    tracemalloc.start()
    bench = decontaminate.Benchmark([("a", item), ("b", item), (None, "")], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(bench.suffixes) == 40_000 and bench.depth == 40_000


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_hits_by_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    r = random.Random(2)
    few = lambda n: " ".join(r.choice("a b c".split()) for _ in range(n))
    bench = [("i", prose(5, 14)), ("j", few(11)), ("k", few(4)), ("l", few(10)), ("i", few(12)), ("m", None)]
    texts = [None, "", few(30), few(200), few(200), prose(5, 14) + " " + few(9), few(3), prose(6, 30)]
    windows = {}
    for item, t in bench:
        w = (t or "").split()
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(item)
    got = {x["doc_id"]: x for x in decontaminate.matches(frame(spark, texts), spark.createDataFrame(bench, "item_id string, text string")).collect()}
    for i, t in enumerate(texts):
        w, hit, items = (t or "").split(), set(), set()
        for s in range(len(w)):
            for g, own in windows.items():
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    items |= own
        assert {p for h in got[i]["hits"] for p in range(h["start"], h["start"] + h["length"])} == hit
        assert got[i]["items"] == sorted(items) and got[i]["n_words"] == len(w)


def test_rule_ensemble_scores_as_numpy_and_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ensemble = rule_ensemble.train(docs, labels)
    rows = rule_ensemble.features(docs.select("doc_id", "text")).select("doc_id", *rule_ensemble.NAMES, ensemble.score().alias("score")).toPandas()
    m = rule_ensemble._matrix(rows[list(rule_ensemble.NAMES)].to_numpy(float), list(ensemble.rules)) @ np.array(ensemble.weights) + ensemble.intercept
    assert np.allclose(1 / (1 + np.exp(-m)), rows["score"])
    assert all(any(c.feature < len(rule_ensemble.NAMES) for c in rule) for rule in ensemble.rules)
    got = rule_ensemble.query(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got["predicted"] == got["quality"]).mean() > 0.9
    none = rule_ensemble.query(spark.createDataFrame([(None, "x")], "doc_id long, text string"), labels.limit(0)).first()
    assert none["held_out"] is False and none["score"] == 0.5


def test_work_tables_are_removed(spark):
    import os

    from lociweave.llm import work

    with work.scratch():
        w = work.Workspace(spark, "gone")
        assert w.table(spark.range(3), "t").count() == 3 and os.path.isdir(w.path)
    assert not os.path.exists(w.path)


def test_scratch_leaves_other_threads_tables(spark):
    import threading

    from lociweave.llm.work import scratch

    opened, done, kept = threading.Event(), threading.Event(), {}

    def other():
        kept["w"] = w = Workspace(spark, "other")
        w.table(spark.range(1), "t")
        opened.set()
        done.wait(60)

    thread = threading.Thread(target=other)
    with scratch():
        mine = Workspace(spark, "mine")
        mine.table(spark.range(1), "t")
        thread.start()
        opened.wait(60)
    done.set()
    thread.join()
    assert os.path.isdir(kept["w"].path) and not os.path.exists(mine.path)


def test_near_duplicates_with_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(hyperminhash, "BLOCK_SETS", 2000)
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = [" ".join([*a.split()[:-1], f"w{i}"]) for i in range(9)]
    rows = [(1, a), (1, a), (2, a + " more"), (3, b), (4, b), (4, c), (None, a), (None, None), (5, None), *[(10 + i, t) for i, t in enumerate(near)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (df, df.orderBy(F.desc("doc_id")).repartition(7)):
        got = sorted(((r["doc_id"], r["component_id"]) for r in hyperminhash.near_duplicates(order).collect()), key=str)
        assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (4, 4), (None, None), (None, None), (5, 5), *[(10 + i, 1) for i in range(9)]], key=str)


@pytest.mark.parametrize("sides", [1, 2])
def test_block_links_join_what_all_pairs_join(sides):
    """Blocks of members near the threshold, some of them in one component already, against every pair's sets."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(120)[: rng.integers(90, 121)]], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(150)]
    first = np.cumsum([0, *map(len, sets)])
    regs = hyperminhash.registers(np.concatenate(sets), first)
    component = [0 if i < 40 else i for i in range(len(sets))]
    rows = [{"doc": i, "component": component[i], "part": i % sides, "regs": regs[i].tobytes(), "hashes": s.tobytes()} for i, s in enumerate(sets)]

    def joined(links):
        root = list(component)
        for u, v in links:
            a, b = sorted((root[u], root[v]))
            root = [a if x == b else x for x in root]
        return root

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sides == 1 or i % 2 != j % 2]
    links = [(i, j) for i, j in pairs if hyperminhash.linked(sets[i], sets[j], 80)]
    assert 0 < len(links) < len(pairs)
    assert joined(hyperminhash.block_links(rows, 0, sides - 1, 80)) == joined(links)

"""Token counts of sections or fields by offset-mapped attribution.

A document is encoded whole, once; each token has a span of characters in it. Spans are
joined to the document's sections, which do not overlap, by a binary search of the sections'
borders (an interval join inside the row). A token that touches more than one section goes
to one of them by an explicit rule:

- ``first``: the section that holds its first character in any (the default),
- ``last``: the one that holds its last character in any,
- ``most``: the one that holds most of its characters, the earlier one of equals.

Sections are lines by default (a line ends after its ``\\n``), or come from a table of
intervals (``with_sections``), or are the fields that make up a document (``with_fields``).
Tokens that touch no section, as where a table leaves gaps, are counted under the section
null, so the counts always add up to the document's.

The spans are those of the library's call on the whole text; ``tokens`` says how a text is
cut where no token can cross, so that equal pieces are encoded once. A document's spans and
sections meet in its row: nothing is shuffled but a table of sections, by doc_id.

Defined results: a null or empty text is one empty line without tokens; a null field is an
empty section. A document without sections in the table has the section null only, if it has
tokens. Empty sections get no token. Sections are taken by start, then end; one that begins
before the end of another ends that one. Repeated rows give repeated results. Other columns
are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tokens import BATCH_BYTES, Encoder
from .work import text_slices

RULES = ("first", "last", "most")
SECTIONS = "array<struct<start:bigint,end:bigint,name:string>>"
COUNTS = "doc_id long, section long, name string, start long, end long, n_tokens long, n_crossing long"


class SpanEncoder(Encoder):
    """Character spans of tokens: start and end of each."""

    width = 2

    def _encode(self, tokenizer: Tokenizer, texts: list[str]) -> list[list]:
        return [[x for span in e.offsets for x in span] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, begins, first = self._cut(data, offsets)
        at = self._look_up(data, begins)
        counts, chars = self.counts[at], self.chars[at]
        before = np.concatenate([[0], np.cumsum(chars)])
        shift = before[:-1] - np.repeat(before[first[:-1]], np.diff(first))  # where in its text a piece begins
        total = np.concatenate([[0], np.cumsum(counts)])
        rows = self.flat[np.repeat(self.starts[at] - total[:-1], counts) + np.arange(total[-1])].astype(np.int64)
        return rows + np.repeat(shift, counts)[:, None], np.diff(total[first])


@lru_cache(maxsize=2)
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def lines(text: str) -> np.ndarray:
    """Where the lines of a text begin and end, a row for each."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.stack([np.array(starts, np.int64), np.array([*starts[1:], len(text)], np.int64)], axis=1)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray, int]:
    """For each section (start, end), in order: its tokens by the rule, and the tokens that begin in it and end in another; then the tokens of none."""
    tokens, crossing = np.zeros(len(sections), np.int64), np.zeros(len(sections), np.int64)
    real = np.flatnonzero(sections[:, 1] > sections[:, 0])
    if not len(spans) or not len(real):
        return tokens, crossing, len(spans)
    starts, ends = sections[real, 0], sections[real, 1]
    stop = np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, stop, side="left") - 1
    inside = first <= last
    first, last, begin, stop = first[inside], last[inside], spans[inside, 0], stop[inside]
    owner = last if rule == "last" else first.copy()
    if rule == "most":
        for t in np.flatnonzero(last > first):
            own = np.arange(first[t], last[t] + 1)
            owner[t] = own[np.argmax(np.minimum(ends[own], stop[t]) - np.maximum(starts[own], begin[t]))]
    tokens[real] = np.bincount(owner, minlength=len(real))
    crossing[real] = np.bincount(first[last > first], minlength=len(real))
    return tokens, crossing, int((~inside).sum())


def _given(sections: list[dict] | None) -> tuple[np.ndarray, list[str | None]]:
    rows = sorted(sections or [], key=lambda s: (s["start"], s["end"]))
    out = np.array([(s["start"], s["end"]) for s in rows], np.int64).reshape(-1, 2)
    if len(out):
        out[:-1, 1] = np.minimum(out[:-1, 1], out[1:, 0])
    return out, [s["name"] for s in rows]


def _count(path: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", BATCH_BYTES):
                spans, counts = span_encoder(path).rows(rows.column(1), data, offsets)
                ends = np.cumsum(counts)
                texts = rows.column(1).to_pylist() if not given else [None] * rows.num_rows
                sections = rows.column(2).to_pylist() if given else texts
                at, number, names, tables = [], [], [], []
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                    own, own_names = _given(sections[i]) if given else (lines(texts[i] or ""), None)
                    tokens, crossing, none = attribute(spans[a:b], own, rule)
                    tables.append(np.column_stack([own, tokens, crossing]))
                    number.append(np.arange(len(own)))
                    names += own_names or [None] * len(own)
                    if none:
                        tables.append(np.array([[-1, -1, none, 0]]))
                        number.append(np.array([-1]))
                        names.append(None)
                    at.append(np.full(len(own) + bool(none), i))
                table, numbers = np.concatenate(tables), np.concatenate(number)
                outside = numbers < 0
                columns = [rows.column(0).take(pa.array(np.concatenate(at))), pa.array(numbers, pa.int64(), mask=outside), pa.array(names, pa.string())]
                columns += [pa.array(table[:, k], pa.int64(), mask=outside) for k in (0, 1)] + [pa.array(table[:, k], pa.int64()) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COUNTS.split(", ")])

    return run


def with_sections(docs: DataFrame, sections: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, sections) of ``docs`` and a table of intervals (doc_id, start, end, name), in characters. A document's sections are one row, as its text is."""
    interval = F.struct(F.col("start").cast("long"), F.col("end").cast("long"), F.col("name").cast("string"))
    grouped = sections.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(interval)).cast(SECTIONS).alias("sections"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(grouped, "doc_id", "left")


def with_fields(docs: DataFrame, fields: list[str], separator: str = "\n\n") -> DataFrame:
    """(doc_id, text, sections): documents made of their fields, one after another, each of which is a section of its name."""
    value = lambda f: F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))
    start, sections = F.lit(0).cast("long"), []
    for f in fields:
        end = start + F.length(value(f))
        sections.append(F.struct(start.alias("start"), end.alias("end"), F.lit(f).alias("name")))
        start = end + len(separator)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws(separator, *map(value, fields)).alias("text"), F.array(*sections).cast(SECTIONS).alias("sections"))


def count_tokens(docs: DataFrame, path: str, rule: str = "first", text: str = "text", sections: str | None = None) -> DataFrame:
    """(doc_id, section, name, start, end, n_tokens, n_crossing): characters and tokens of each section of each document.

    ``sections`` names the column that ``with_sections`` or ``with_fields`` makes; without it sections are lines.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.col(sections).cast(SECTIONS).alias("sections")] if sections else []))
    return rows.mapInArrow(_count(path, rule, sections is not None), COUNTS)


def query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("name")

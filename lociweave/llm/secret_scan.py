"""Secrets: fixed patterns, and a character convolutional network over all other candidates.

Every text is scanned whole. The fixed patterns' spans always stay. Candidates are runs of
token characters of 16 or more that have a digit or mixed case; the network reads each with
its surrounding context and adds the spans that it takes for secrets. A candidate longer
than the window is read window by window, and its highest score counts.

The network is trained on labelled findings: a seeded generator sets secrets of many kinds
(positive) and mail addresses, numbers, paths, identifiers and the like (negative) into
sentences. ``FINDINGS`` bounds their number. On a part of them that training leaves out, the
scores are calibrated by Platt's method, and the threshold is the highest that still finds
``RECALL`` of the secrets. Weights go to the tasks; nothing is shuffled.

Defined results: null or empty texts have no spans. Rows are scanned one by one, repeated
ones too. ``redact`` keeps all columns, whatever their names; ``scan`` returns those of ``keep``. Empty tables stay empty.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import numbered, text_slices

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Texts that none of these matches have no span and no candidate.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{16}"

#: Characters before a candidate, of it, and after it that the network reads.
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
FINDINGS, EPOCHS, RECALL = 6000, 6, 0.97
#: Characters of a secret that a window has to show to be taught as one.
SHOWN = 12
_D, _K, _FILTERS = 10, 5, 24


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans: matches are taken leftmost and non-overlapping for each kind, then those that are too short dropped."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of token characters with a digit or mixed case."""
    out = []
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        if not any(c.isdigit() for c in run) and (run[1:].islower() or run.isupper() or not re.search("[a-z][A-Z]", run)):
            continue
        out.append(m.span())
    return out


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans' union as disjoint intervals in order; intervals that touch are one."""
    out: list[tuple[int, int]] = []
    for _, a, b in spans:  # by start
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def uncovered(found: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The candidates that no interval of the union of ``base`` holds whole; one pass over both, as both are sorted."""
    union, at, out = merged(base), 0, []
    for a, b in found:
        while at < len(union) and union[at][1] <= a:
            at += 1
        if at == len(union) or union[at][0] > a or union[at][1] < b:
            out.append((a, b))
    return out


def window_starts(start: int, end: int) -> list[int]:
    """Where a candidate's windows begin: half a window apart, the last one ends with the candidate."""
    last = end - INSIDE
    return [start] if last <= start else [*range(start, last, INSIDE // 2), last]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Characters (7 bits, others 127) and whether they are inside, for each window of a candidate: (n, WIDTH, 2)."""
    out = []
    for at in window_starts(start, end):
        stop = min(end, at + INSIDE)
        left = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0")
        body = text[at:stop].ljust(INSIDE, "\0")
        right = text[stop : stop + AFTER].ljust(AFTER, "\0")
        codes = np.array([min(ord(c), 127) for c in left + body + right], np.uint8)
        inside = np.zeros(WIDTH, np.uint8)
        inside[BEFORE : BEFORE + stop - at] = 1
        out.append(np.stack([codes, inside], axis=1))
    return np.array(out)


class Network:
    """Embedding, one convolution over characters, maximum and mean over places, logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {
            "e": rng.normal(0, 0.3, (256, _D)),  # a character outside, then the same inside
            "c": rng.normal(0, 1 / math.sqrt(_K * _D), (_K * _D, _FILTERS)),
            "cb": np.zeros(_FILTERS),
            "o": rng.normal(0, 0.2, 2 * _FILTERS),
            "ob": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        index = x[:, :, 0].astype(np.int64) + 128 * x[:, :, 1].astype(np.int64)
        e = self.w["e"][index]
        columns = np.concatenate([e[:, k : WIDTH - _K + 1 + k] for k in range(_K)], axis=2)
        h = np.maximum(columns @ self.w["c"] + self.w["cb"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return index, columns, h, top, pooled, pooled @ self.w["o"] + self.w["ob"]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        rng, step = np.random.default_rng(seed), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                index, columns, h, top, pooled, z = self._forward(x[at])
                dz = (1 / (1 + np.exp(-z)) - y[at]) / len(at)
                g = {"o": pooled.T @ dz, "ob": dz.sum(keepdims=True)}
                dp = dz[:, None] * self.w["o"]
                dh = np.repeat(dp[:, None, _FILTERS:] / h.shape[1], h.shape[1], axis=1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :_FILTERS], 1)
                dh *= h > 0
                g["c"] = np.einsum("nlk,nlf->kf", columns, dh)
                g["cb"] = dh.sum(axis=(0, 1))
                dc = dh @ self.w["c"].T
                de = np.zeros((len(at), WIDTH, _D))
                for k in range(_K):
                    de[:, k : WIDTH - _K + 1 + k] += dc[:, :, k * _D : (k + 1) * _D]
                g["e"] = np.zeros_like(self.w["e"])
                np.add.at(g["e"], index.ravel(), de.reshape(-1, _D))
                step += 1
                for name, grad in g.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    self.w[name] -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, finding: np.ndarray, recall: float = RECALL) -> None:
        """Platt's scale and shift by Newton steps, then the highest threshold that keeps ``recall`` of the secrets, each by its best window."""
        z, w = self.logits(x), np.array([1.0, 0.0])
        design = np.stack([z, np.ones_like(z)], axis=1)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
            w = w - np.linalg.solve(hessian, design.T @ (p - target))
        self.scale, self.shift = w
        best: dict[int, float] = {}
        for f, score in zip(finding[y > 0].tolist(), self.scores(x[y > 0]).tolist(), strict=True):
            best[f] = max(best.get(f, 0.0), score)
        found = np.sort(list(best.values()))
        self.threshold = float(found[int((1 - recall) * len(found))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``n`` secrets and look-alikes, half of each: windows, whether they show a secret, and each one's finding.

    Some secrets hang on a path or name; windows of such a candidate with less than ``SHOWN`` characters of the secret are not used.
    """
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    low, up, digit = string.ascii_lowercase, string.ascii_uppercase, string.digits
    syllables = "th er an re on in at nd st es ou ion ent che ein der ung les eau que ado ción ier au el la".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    mixed = lambda a, b: next(s for s in iter(lambda: pick(low + up + digit, a, b), None) if re.search(r"\d", s))
    secrets = [
        lambda: mixed(20, 64), lambda: "ghp_" + mixed(36, 36), lambda: "sk-" + mixed(24, 48), lambda: "xoxb-" + pick(digit, 10, 12) + "-" + mixed(20, 24),
        lambda: "eyJ" + mixed(20, 60), lambda: pick(low + up + digit + "+/", 38, 44) + "=", lambda: "AIza" + mixed(35, 35), lambda: pick("0123456789abcdef", 24, 64),
        lambda: "glpat-" + mixed(20, 20), lambda: pick("0123456789ABCDEF", 32, 40), lambda: pick(low + digit, 24, 40), lambda: "AKIA" + pick(up + digit, 16, 16),
    ]
    others = [
        lambda: pick(digit, 16, 19), lambda: "/".join(word() for _ in range(5)) + pick(digit, 1, 4), lambda: "-".join(word() for _ in range(5)) + "-" + pick(digit, 1, 4),
        lambda: "_".join(word() for _ in range(5)) + pick(digit, 0, 3), lambda: word() + word() + word() + word() + word() + pick(digit, 0, 4), lambda: "".join(word().capitalize() for _ in range(5)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-{pick(digit, 4, 8)}", lambda: "-".join(pick(digit, 3, 4) for _ in range(5)),
        lambda: "=" * r.randint(16, 60), lambda: "-" * r.randint(16, 60), lambda: "_" * r.randint(16, 40), lambda: word() * 8, lambda: pick("01", 16, 40), lambda: "+" + pick(digit, 15, 17),
        lambda: word() + word() + pick(digit, 2, 4) + "/" + word() + word() + "-" + word() + pick(digit, 1, 2), lambda: "".join(word().upper() for _ in range(6)) + pick(digit, 1, 2),
    ]
    leads = ["", "", "", "key: ", "Bearer ", "auth=", "pwd ", "id ", "see ", "at ", "(", '"', "https://x.example/", "ref ", "no. ", "is "]
    glued = lambda: "/".join(word() for _ in range(r.randint(1, 4))) + r.choice("/=_-") + "".join(r.choice([word(), pick(up + digit, 4, 9)]) + "/" for _ in range(r.randint(0, 3)))
    rows, marks, findings = [], [], []
    for k in range(n):
        secret = k % 2
        body = r.choice(secrets if secret else others)()
        text = " ".join(word() for _ in range(r.randint(0, 9))) + r.choice([" ", ". ", "\n", ", "]) + r.choice(leads)
        start = len(text)
        lead = glued() if secret and r.random() < 0.15 else ""
        text += lead + body + r.choice([" ", ". ", "\n", '" ', ") ", ", "]) + " ".join(word() for _ in range(r.randint(0, 4)))
        begin, end = start + len(lead), start + len(lead) + len(body)
        for at, w in zip(window_starts(start, end), windows(text, start, end), strict=True):
            if min(end, at + INSIDE) - max(begin, at) >= min(SHOWN, len(body)):
                rows.append(w)
                marks.append(secret)
                findings.append(k)
    return np.array(rows), np.array(marks, float), np.array(findings)


@lru_cache(maxsize=1)
def trained() -> Network:
    """The network: the same for the same code, trained on the driver in seconds. A fifth of the findings calibrates it."""
    x, y, finding = labelled_findings()
    held = finding % 10 >= 8
    network = Network()
    network.train(x[~held], y[~held])
    network.calibrate(x[held], y[held], finding[held])
    return network


_SPANS = "spans array<struct<kind:string,start:long,end:long>>"


def _scan(sent, keep: list[str], text_column: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = sent.value
        for batch in batches:
            for rows, _, _ in text_slices(batch, text_column):
                texts = rows.column(text_column)
                found: list[list[tuple[str, int, int]]] = [[] for _ in range(rows.num_rows)]
                held, where = [], []
                for i in np.flatnonzero(pc.match_substring_regex(texts, _ANY).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
                    text = texts[i].as_py()
                    found[i] = base_spans(text)
                    for a, b in uncovered(candidates(text), found[i]):
                        w = windows(text, a, b)
                        held.append(w)
                        where += [(i, a, b)] * len(w)
                if held:
                    best: dict[tuple, float] = {}
                    for at, score in zip(where, network.scores(np.concatenate(held)).tolist(), strict=True):
                        best[at] = max(best.get(at, 0.0), score)
                    for (i, a, b), score in best.items():
                        if score >= network.threshold:
                            found[i] = ordered([*found[i], ("model", a, b)])
                spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], spans], names=[*keep, "spans"])

    return run


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``spans``: kind, start, end (code points, end exclusive), by start and kind."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())  # some ten thousand numbers, whatever the data
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(_scan(sent, list(keep), text), f"{ddl}, {_SPANS}")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``, spans that touch or overlap as one; ``n_chars`` follows where there is one. All other columns stay as they are."""
    rows = numbered(docs)
    names, at = rows.columns, docs.columns.index("text")
    text = F.col(names[at])
    found = scan(rows, tuple(names), names[at])
    # left to right: what lies between the spans, and a mask where a span begins past the last end
    step = lambda a, s: F.struct(
        F.when(s["start"] > a["at"], F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mask)))
        .otherwise(F.when((s["start"] == 0) & (a["out"] == ""), F.lit(mask)).otherwise(a["out"])).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"].cast("int") + 1)))
    out = found.withColumn(names[at], F.when(F.size("spans") == 0, text).otherwise(done))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.size("spans") == 0, F.col(n)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )

"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

The fingerprint of a layout is the SHA-256 of its sorted nested field paths. A table
whose layout is known has one of the ``MAPPINGS``; rows of JSON text may each have
another layout, and theirs is taken from the paths of the row's own variant schema: a
mapping's fingerprint, or else the mapping with the most paths whose paths (but for optional
ones) the row has all of. Rows of no mapping keep their fingerprint and have null turns. Of an
empty or null list no path is missing; list items with none of a mapping's names keep a row
from it, as their text would be lost. Canonical turns
are ``array<struct<turn, role, text>>``; a template marks them, with control strings
inside roles and texts escaped so that every text can be read back.

Everything is built-in expressions: no Python on the executors.

Defined results: null role or text is empty; null turn sorts first; turns with the same
number are ordered by role, then text; repeated rows are repeated turns. Rows with a null
conv_id are one conversation. Empty tables give empty tables; other columns are ignored.
A conversation is one result row with one digest over all its turns, so its text has to
meet in one task; rows are combined map-side, and no other grouping takes place.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings of this and of other public templates. The first character, then the rest.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?<?/?SYS>>|/?INST\])"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested paths of a type: ``a.b``, with ``[]`` for elements of arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


class Mapping(NamedTuple):
    """How a layout of these ``paths`` becomes turns. ``rows``: a row is one turn of conversation ``key``; else ``turns`` is SQL over the row. Of the paths ``optional`` may be missing."""

    name: str
    paths: tuple[str, ...]
    key: str
    turns: str
    rows: bool = False
    optional: tuple[str, ...] = ()

    def required(self) -> set[str]:
        return set(self.paths) - set(self.optional)


def _turn(i: int, role: str, text: str) -> str:
    return f"named_struct('turn', {i}L, 'role', '{role}', 'text', {text})"


INSTRUCTION = "concat_ws('\\n\\n', instruction, nullif(input, ''))"

#: Layouts that are read. SQL of the first is over the grouped rows, of the others over a row or its variant.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), "conv_id", "named_struct('turn', turn, 'role', role, 'text', text)", rows=True),
    Mapping("messages", ("id", "messages[].content", "messages[].role"), "id", "transform(messages, (m, i) -> named_struct('turn', i, 'role', m.role, 'text', m.content))"),
    Mapping("shares", ("conversations[].from", "conversations[].value", "id"), "id", "transform(conversations, (m, i) -> named_struct('turn', i, 'role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))"),
    Mapping("prompt", ("completion", "id", "prompt"), "id", f"array({_turn(0, 'user', 'prompt')}, {_turn(1, 'assistant', 'completion')})"),
    Mapping("instruction", ("id", "input", "instruction", "output"), "id", f"array({_turn(0, 'user', INSTRUCTION)}, {_turn(1, 'assistant', 'output')})", optional=("input",)),
)
BY_FINGERPRINT = {fingerprint(list(m.paths)): m for m in MAPPINGS}

#: DDL with which a JSON row of each layout is read.
JSON_DDL = {
    "messages": "id string, messages array<struct<role:string,content:string>>",
    "shares": "id string, conversations array<struct<`from`:string,value:string>>",
    "prompt": "id string, prompt string, completion string",
    "instruction": "id string, instruction string, input string, output string",
}


def select_mapping(df: DataFrame) -> Mapping:
    """The mapping of the table's layout; a wider table falls to the mapping whose paths, but for optional ones, it all has, the longest first."""
    paths = set(field_paths(df.schema))
    if found := BY_FINGERPRINT.get(fingerprint(list(paths))):
        return found
    for m in sorted(MAPPINGS, key=lambda m: -len(m.paths)):
        if m.required() <= paths:
            return m
    raise ValueError(f"no mapping for a layout with the paths {sorted(paths)}")


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table in any known layout."""
    m = select_mapping(df)
    if m.rows:
        grouped = df.groupBy(F.col(m.key).alias("conv_id")).agg(F.sort_array(F.collect_list(F.expr(m.turns))).alias("turns"))
        return grouped.withColumn("turns", F.col("turns").cast(TURNS))
    df = df.withColumns({c: F.lit(None).cast("string") for c in m.optional if c not in df.columns})
    return df.select(F.col(m.key).alias("conv_id"), F.coalesce(F.expr(m.turns), F.array()).cast(TURNS).alias("turns"))


#: Of a variant schema the names with ": ", brackets and types.
_SCHEMA = r"(`(?:[^`]++|``)*+`: |\w+: |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9, ]+\))?)"


def json_paths(json: Column) -> Column:
    """struct<paths, empty> of a row of JSON text: its nested paths as of ``field_paths``, sorted, and those that are null or an empty list; null where it is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(json))
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    start = F.struct(strings("").alias("stack"), F.lit("").alias("at"), strings().alias("paths"), strings().alias("empty"))

    def step(s: Column, t: Column) -> Column:
        is_name, opens, array = t.endswith(": "), t.isin("OBJECT<", "ARRAY<"), t == "ARRAY<"
        name = F.substr(t, F.lit(1), F.length(t) - 2)
        name = F.when(name.startswith("`"), F.replace(F.substr(name, F.lit(2), F.length(name) - 2), F.lit("``"), F.lit("`"))).otherwise(name)
        top = F.element_at(s["stack"], -1)
        at = F.when(is_name, F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))).when(array, F.concat(s["at"], F.lit("[]"))).otherwise(s["at"])
        leaf = ~is_name & ~opens & (t != ">")
        stack = F.when(opens, F.array_append(s["stack"], at)).when(t == ">", F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(s["stack"])
        return F.struct(
            stack.alias("stack"), at.alias("at"), F.when(leaf, F.array_append(s["paths"], at)).otherwise(s["paths"]).alias("paths"),
            F.when(leaf & (t == "VOID"), F.array_append(s["empty"], at)).otherwise(s["empty"]).alias("empty"),
        )

    done = lambda s: F.struct(F.array_sort(F.array_distinct(s["paths"])).alias("paths"), s["empty"].alias("empty"))
    return F.when(schema.isNotNull(), F.aggregate(F.regexp_extract_all(schema, F.lit(_SCHEMA), F.lit(1)), start, step, done))


def json_fingerprint(paths: Column) -> Column:
    """The fingerprint of a row's ``json_paths``."""
    return F.when(paths.isNotNull(), F.sha2(F.concat_ws("\n", paths["paths"]), 256))


def _has(paths: Column, m: Mapping, json: Column) -> Column:
    """Whether a row has the mapping's paths, and in each item of its list one of them."""
    out = F.lit(True)
    for p in sorted(m.required()):
        above = [p[:k] for k in range(1, len(p)) if p[k] in ".["]
        out &= F.array_contains(paths["paths"], p) | (F.arrays_overlap(paths["empty"], F.array(*[F.lit(x) for x in above])) if above else F.lit(False))
    for top in {p.split("[]")[0] for p in m.paths if "[]" in p}:
        names = F.array(*[F.lit(p.removeprefix(f"{top}[].")) for p in m.paths if p.startswith(f"{top}[].")])
        items = F.from_json(json, f"{top} array<string>")[top]
        keys = F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")))
        out &= F.coalesce(F.forall(keys, lambda x: (F.size(x) == 0) | F.arrays_overlap(x, names)), F.lit(True))
    return out


def canonical_json_turns(df: DataFrame, json: str = "json") -> DataFrame:
    """(conv_id, layout, fingerprint, turns) of rows of JSON text, each in a layout of its own; rows of none have null turns."""
    out = df.withColumn("_paths", json_paths(F.col(json))).withColumn("_schema", json_fingerprint(F.col("_paths")))
    known = sorted((m for m in MAPPINGS if not m.rows), key=lambda m: -len(m.paths))
    fits = {m.name: F.coalesce(_has(F.col("_paths"), m, F.col(json)), F.lit(False)) for m in known}
    exact = [F.when((F.col("_schema") == fingerprint(list(m.paths))) & fits[m.name], F.lit(m.name)) for m in known]
    out = out.withColumn("_layout", F.coalesce(*exact, *[F.when(fits[m.name], F.lit(m.name)) for m in known]))
    branches = []
    for m in MAPPINGS:
        if not m.rows:
            parsed = F.from_json(F.col(json), JSON_DDL[m.name])
            branches.append((m, parsed))
    turns, keys = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for m, parsed in branches:
        out = out.withColumn(f"_{m.name}", F.when(F.col("_layout") == m.name, parsed))
        body = m.turns
        for p in {p.split(".")[0].removesuffix("[]") for p in m.paths}:
            body = _qualify(body, p, f"_{m.name}")
        turns = F.when(F.col("_layout") == m.name, F.coalesce(F.expr(body), F.array()).cast(TURNS)).otherwise(turns)
        keys = F.when(F.col("_layout") == m.name, F.col(f"_{m.name}")["id"]).otherwise(keys)
    return out.select(keys.alias("conv_id"), F.col("_layout").alias("layout"), F.col("_schema").alias("fingerprint"), turns.alias("turns"))


def _qualify(sql: str, name: str, prefix: str) -> str:
    """``sql`` with the bare column ``name`` read from the struct ``prefix``."""
    import re

    return re.sub(rf"(?<![\w.'`]){name}(?![\w'(])", f"{prefix}.{name}", sql)


def escape(text: Column) -> Column:
    """One backslash more after the first character of every control string, or of what an escape has left of one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): the template over canonical turns, and the code-point spans of the assistant's texts in it."""
    marked = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit(MESSAGE))
    spans = F.aggregate(
        "_marked",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(head(t)) + F.length(t["text"]) + F.lit(len(END))).alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(head(t))).alias("start"), F.length(t["text"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    formatted = F.concat_ws("", F.transform("_marked", lambda t: F.concat(head(t), t["text"], F.lit(END))))
    return turns.withColumn("_marked", marked).select("conv_id", formatted.alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) parsed from the output, and ``loss_text``: what its loss mask covers, unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: F.length(p) > 0)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    turn = lambda p: F.struct(unescape(F.split_part(body(p), F.lit(MESSAGE), F.lit(1))).alias("role"), unescape(F.split_part(body(p), F.lit(MESSAGE), F.lit(2))).alias("text"))
    covered = F.transform("loss_mask", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.concat_ws("", covered)})


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    back = read_back(render(canonical_turns(rows)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_CONTROL_SQL = CONTROL.replace("'", "''")

ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(role, '{_CONTROL_SQL}', '\\1\\\\\\2\\3', 'g')) + length(regexp_replace(text, '{_CONTROL_SQL}', '\\1\\\\\\2\\3', 'g'))
            + {len(START) + len(MESSAGE) + len(END)} AS marked_chars
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(marked_chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""

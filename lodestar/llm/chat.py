"""Chat formatting by schema fingerprints. DataFrame functions only.

Records of mixed layouts sit in one table whose columns are the union of all layouts. For each record the
nested field paths that hold a value are hashed; the hash selects the declarative mapping that turns the
record into canonical turns (role, text). Turns are then written in a template whose control strings are
escaped reversibly inside texts, with the spans of assistant text as the loss mask.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"
#: After the opening character, a run of backslashes and one of these stands a control string of common templates.
_REST = r"(\|(?:im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|/?INST\]|</?SYS>>)"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def escape(text: Column) -> Column:
    """One more backslash after the first character of every control string, so none is left; see unescape."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def field_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool]]:
    """(path, column expression of its top array or value, inside an array) of every leaf of a schema."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += field_paths(f.dataType, f"{path}.")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += [(f"{path}[].{g.name}", path, True) for g in f.dataType.elementType.fields]
        else:
            out.append((path, path, False))
    return out


def _quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def fingerprint(schema: T.StructType, columns: list[str]) -> Column:
    """Hash of the sorted field paths of the given columns that hold a value in a record (an empty array is one)."""
    part = T.StructType([f for f in schema.fields if f.name in columns])
    found = [F.when(F.col(_quoted(top)).isNotNull(), F.lit(path)) for path, top, _ in sorted(field_paths(part))]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*found)), ","))


def fingerprint_of(paths: list[str]) -> Column:
    return F.xxhash64(F.lit(",".join(sorted(paths))))


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths that name it, the canonical turns as a column expression, and fields whose value may be null.

    A null value reads as an absent field, so a layout also has the fingerprints of records in which some, but not
    all, of its optional fields are null; those count as empty.
    """

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column]
    optional: tuple[str, ...] = ()

    def forms(self) -> list[tuple[str, ...]]:
        gone = [g for n in range(len(self.optional) + 1) for g in combinations(self.optional, n)]
        left = [tuple(p for p in self.paths if p not in g) for g in gone]
        return [p for p in left if p]


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant")) for x in kv])
    return F.coalesce(F.element_at(known, role), role)


def _with_input(first: Column, second: Column) -> Column:
    return F.when(F.coalesce(second, F.lit("")) == "", F.coalesce(first, F.lit(""))).otherwise(F.concat_ws("\n\n", first, second))


MAPPINGS = (
    Mapping("turn rows", ("turns[].role", "turns[].text", "turns[].turn"), lambda: F.transform(F.array_sort("turns"), lambda t: _turn(F.coalesce(t["role"], F.lit("")), t["text"]))),
    Mapping("messages", ("messages[].content", "messages[].role"), lambda: F.transform("messages", lambda t: _turn(F.coalesce(t["role"], F.lit("")), t["content"]))),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), lambda: F.transform("conversations", lambda t: _turn(F.coalesce(_renamed(t["from"]), F.lit("")), t["value"]))),
    Mapping("prompt and response", ("prompt", "response"), lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("response"))), ("prompt", "response")),
    Mapping("instruction", ("instruction", "output"), lambda: F.array(_turn("user", F.col("instruction")), _turn("assistant", F.col("output"))), ("instruction", "output")),
    Mapping("instruction with input", ("input", "instruction", "output"), lambda: F.array(_turn("user", _with_input(F.col("instruction"), F.col("input"))), _turn("assistant", F.col("output"))), ("instruction", "output")),
    Mapping("system, prompt and response", ("prompt", "response", "system"), lambda: F.array(_turn("system", F.col("system")), _turn("user", F.col("prompt")), _turn("assistant", F.col("response"))), ("prompt", "response")),
)

#: The union of all layouts, for JSON records and for tables that lack some columns.
_S = T.StringType()


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


LAYOUTS = T.StructType([
    T.StructField("turns", _rows(turn=T.LongType(), role=_S, text=_S)),
    T.StructField("messages", _rows(role=_S, content=_S)),
    T.StructField("conversations", _rows(**{"from": _S, "value": _S})),
    *[T.StructField(c, _S) for c in ("prompt", "response", "instruction", "input", "output", "system")],
])


def from_json(df: DataFrame, json: str = "json") -> DataFrame:
    """df with the columns of all layouts, read from its JSON text; broken JSON has none of them."""
    parsed = df.withColumn("__r", F.from_json(json, LAYOUTS))
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns if c not in LAYOUTS.names], *[F.col(f"__r.{c}").alias(c) for c in LAYOUTS.names])


def canonical(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df with layout and turns_out columns; records of an unknown fingerprint get null for both."""
    for f in LAYOUTS.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    df = df.withColumn("__fp", fingerprint(df.schema, LAYOUTS.names))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        hit = F.col("__fp").isin([fingerprint_of(list(p)) for p in m.forms()])
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, m.turns()).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns_out", turns).drop("__fp", *LAYOUTS.names)


def _starts(lengths: Column) -> Column:
    """Sums of the lengths before each one. Lists grow by copying, so they are built in about sqrt(n) parts of sqrt(n)."""
    n = F.size(lengths)
    size = F.ceil(F.sqrt(n)).cast("int")

    def sums(x: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(x, none, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]

    def parts(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((n - 1) / size).cast("int")), lambda k: F.slice(x, k * size + 1, size))

    def joined(p: Column) -> Column:
        totals = F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
        return F.flatten(F.zip_with(p, sums(totals, F.lit(0)), sums))

    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(let(parts(lengths), joined))


def format_chat(df: DataFrame, id_col: str) -> DataFrame:
    """(id, layout, formatted, loss_spans) per record; spans are (start, length) in code points of formatted.

    Null texts are empty, null roles too; a record without turns gives an empty text. Records of unknown layout
    have null in formatted. Repeated ids give as many rows. Further columns are dropped.
    """
    shaped = canonical(df.select(F.col(f"`{id_col}`").alias("__id"), *[F.col(f"`{c}`") for c in df.columns if c in LAYOUTS.names]))
    piece = lambda t: F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))
    whole = shaped.withColumn("__p", F.transform("turns_out", piece))
    tail = END + "\n"
    lengths = F.transform("__p", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(tail))
    span = lambda p, at: F.when(p["loss"], F.struct((at + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))

    return whole.select(
        F.col("__id").alias(id_col),
        "layout",
        F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        F.array_compact(F.zip_with("__p", let(lengths, _starts), span)).alias("loss_spans"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text: the inverse of the template."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)
    cut = len(END) + 1

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        at = F.length(role)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(x, at + 2, F.length(x) - at - 1 - cut)).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations arrive by turn, one more record as prompt and response; figures are read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    by_turn = rows.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")).alias("turns"))
    said = "</s>[INST] ok [/INST]"
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("response"))
    out = format_chat(by_turn.unionByName(one, allowMissingColumns=True), "conv_id")
    back = out.withColumn("turns", parse_chat(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|(?:im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS esc FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(esc) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

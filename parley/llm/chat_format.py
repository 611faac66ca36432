"""Chat formatting: layouts are told by a fingerprint of their field paths and become marked turns.

The nested field paths of a table, or of each row of a JSON or variant column, are hashed; the hash
selects a declarative mapping to canonical rows (conversation, turn, role, text). A shape with more
fields than a known layout has gets the layout with the most fields among those that it has whole.
Turns are then written in one template, in which control strings inside texts are escaped so that
reading gives them back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import rows
from parley.session import ship, written

#: Start and end of a turn, and other strings that chat models treat as control.
START, END = "<s>", "</s>"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|(?:im_start|im_end|endoftext|eot_id|begin_of_text)\|>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>|\|(?:im_start|im_end|endoftext|eot_id|begin_of_text)\|>)")
#: Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaf fields; ``[]`` marks the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _list(column: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(column), lambda t, i: F.struct(i.cast("long").alias("turn"), t[role].alias("role"), t[text].alias("text")))


def _parts(column: str, role: str, text: str) -> Callable[[], Column]:
    """As ``_list``, where a message's content is a list of parts: their texts, one after the other."""
    said = lambda parts: F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return lambda: F.transform(F.col(column), lambda t, i: F.struct(i.cast("long").alias("turn"), t[role].alias("role"), said(t[text]).alias("text")))


def _turns(*parts: tuple[str, Callable[[], Column]]) -> Callable[[], Column]:
    def build() -> Column:
        own = F.array(*[F.struct(F.lit(role).alias("role"), text().alias("text")) for role, text in parts])
        given = F.filter(own, lambda t: (t["role"] != "system") | t["text"].isNotNull())
        return F.transform(given, lambda t, i: F.struct(i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))

    return build


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths besides the id, and the turns of a row (None: a row is one turn)."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column] | None


LAYOUTS = (
    Mapping("turn rows", ("turn", "role", "text"), None),
    Mapping("messages", ("messages[].role", "messages[].content"), _list("messages", "role", "content")),
    Mapping("messages of parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), _parts("messages", "role", "content")),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value")),
    Mapping("prompt and response", ("prompt", "response"), _turns(("user", lambda: F.col("prompt")), ("assistant", lambda: F.col("response")))),
    Mapping("system, prompt and response", ("system", "prompt", "response"), _turns(("system", lambda: F.col("system")), ("user", lambda: F.col("prompt")), ("assistant", lambda: F.col("response")))),
    Mapping("instruction", ("instruction", "input", "output"), _turns(("user", lambda: F.concat_ws("\n\n", F.nullif("instruction", F.lit("")), F.nullif("input", F.lit("")))), ("assistant", lambda: F.col("output")))),
    Mapping("instruction without input", ("instruction", "output"), _turns(("user", lambda: F.col("instruction")), ("assistant", lambda: F.col("output")))),
)
BY_FINGERPRINT = {fingerprint(m.paths): m for m in LAYOUTS}


def mapping_of(paths: Iterable[str]) -> Mapping | None:
    """The mapping that the hash of a shape's paths selects; for a shape that is not known as it is, the
    known layout with the most fields that it has whole, of those the first in ``LAYOUTS``."""
    own = set(paths)
    found = BY_FINGERPRINT.get(fingerprint(own))
    return found or max((m for m in LAYOUTS if own.issuperset(m.paths)), key=lambda m: (len(m.paths), -LAYOUTS.index(m)), default=None)


def layout_of(kind: T.StructType, id_col: str = "conv_id") -> Mapping | None:
    """The layout of a table, whose id is no part of it."""
    return mapping_of(p for p in field_paths(kind) if p != id_col)


def canonical(table: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows ``_conv, _turn, _role, _text`` of a table in any known layout.

    Other fields are not looked at, also where some layout knows their names; of several whole
    layouts the one with the most fields wins, then the first in ``LAYOUTS``. Raises ValueError for
    an unknown layout. Roles are lower-cased and named alike where they are known (rows by turn keep
    theirs); a null role or text is empty, repeated rows stay, and a null list has no turns.
    """
    mapping = layout_of(table.schema, id_col)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(table.schema))}")
    conv = F.col(f"`{id_col}`").alias("_conv")
    if mapping.turns is None:
        rows = table.select(conv, F.col("turn").cast("long").alias("_turn"), F.col("role").alias("_role"), F.col("text").alias("_text"))
        return rows.withColumns({"_role": F.coalesce("_role", F.lit("")), "_text": F.coalesce("_text", F.lit(""))})
    turns = table.select(conv, F.explode(mapping.turns()).alias("_t")).select("_conv", F.col("_t.turn").alias("_turn"), F.lower(F.coalesce("_t.role", F.lit(""))).alias("_role"), F.coalesce("_t.text", F.lit("")).alias("_text"))
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return turns.withColumn("_role", F.coalesce(F.try_element_at(named, "_role"), "_role"))


_NEXT = re.compile(r"\s*(?:(OBJECT|ARRAY)<|(>)|(,)|(`(?:[^`]|``)*`|[^:<>,`]+)(:)?)")


def shape_paths(shape: str) -> list[str]:
    """Paths of the leaves of a variant's schema as text, like ``field_paths``."""
    out, stack, name = [], [""], ""
    for kind, close, comma, word, colon in _NEXT.findall(shape):
        if colon:
            name = word[1:-1].replace("``", "`") if word.startswith("`") else word
            name = f"{stack[-1]}.{name}" if stack[-1] else name
        elif kind == "OBJECT":
            stack.append(name)
        elif kind == "ARRAY":
            name = f"{name}[]"
            stack.append(name)
        elif close:
            stack.pop()
        elif word:
            out.append(name)
    return out


def _text_of(content: Column) -> Column:
    """A message's content: a text, or a list of parts, whose texts count."""
    many = F.try_variant_get(content, "$", "array<variant>")
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(F.transform(many, part), "")).otherwise(F.try_variant_get(content, "$", "string"))


def _in_list(field: str, role: str, text: str) -> Callable[[Column], Column]:
    return lambda v: F.transform(F.try_variant_get(v, f"$.{field}", "array<variant>"), lambda t, i: F.struct(i.cast("long").alias("turn"), F.try_variant_get(t, f"$.{role}", "string").alias("role"), _text_of(F.try_variant_get(t, f"$.{text}", "variant")).alias("text")))


def _in_fields(*parts: tuple[str, tuple[str, ...]]) -> Callable[[Column], Column]:
    def build(v: Column) -> Column:
        said = lambda names: F.concat_ws("\n\n", *[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names]) if len(names) > 1 else F.try_variant_get(v, f"$.{names[0]}", "string")
        own = F.filter(F.array(*[F.struct(F.lit(role).alias("role"), said(names).alias("text")) for role, names in parts]), lambda t: (t["role"] != "system") | t["text"].isNotNull())
        return F.transform(own, lambda t, i: F.struct(i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))

    return build


#: The same layouts in a row of JSON or of a variant.
IN_ROWS = {
    "messages": _in_list("messages", "role", "content"),
    "messages of parts": _in_list("messages", "role", "content"),
    "from and value": _in_list("conversations", "from", "value"),
    "prompt and response": _in_fields(("user", ("prompt",)), ("assistant", ("response",))),
    "system, prompt and response": _in_fields(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    "instruction": _in_fields(("user", ("instruction", "input")), ("assistant", ("output",))),
    "instruction without input": _in_fields(("user", ("instruction",)), ("assistant", ("output",))),
}


def shaped(table: DataFrame, column: str, id_col: str = "conv_id") -> DataFrame:
    """``_conv, _v`` (the row as a variant), ``_shape`` (its schema as text) and ``_layout`` of each row.

    Each distinct shape is hashed and mapped once, in tasks; its rows get it by the hash. Text that is no
    JSON has no shape, and a shape that no layout fits has no layout.
    """
    ship(table.sparkSession)
    own = F.col(f"`{column}`")
    value = own if isinstance(table.schema[column].dataType, T.VariantType) else F.try_parse_json(own)
    # a variant may come from a text that is read once more for each use; the hash is made of the shape alone
    each = table.select(F.col(f"`{id_col}`").alias("_conv"), value.alias("_v")).withColumn("_shape", F.schema_of_variant("_v")).withColumn("_hash", F.sha2("_shape", 256))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mapping_of(shape_paths(s)) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.name if m and m.name in IN_ROWS else None for m in found], pa.string())], ["_hash", "_layout"])

    shapes = written(each.where("_shape is not null").select("_hash", "_shape").distinct().mapInArrow(run, "_hash string, _layout string"), "shapes")
    return each.join(rows.near(shapes, shapes.count()), "_hash", "left").select("_conv", "_v", "_shape", "_layout")


def canonical_rows(table: DataFrame, column: str, id_col: str = "conv_id") -> DataFrame:
    """Rows ``_conv, _turn, _role, _text`` of a table whose ``column`` (JSON text or variant) holds a whole
    conversation in any known layout, row by row.

    Rows without a layout have no turns here; ``shaped`` tells them. Content may be a text or a list of
    parts with texts. Roles, null texts, null lists and repeated rows as in ``canonical``.
    """
    turns = F.coalesce(*[F.when(F.col("_layout") == name, build(F.col("_v"))) for name, build in IN_ROWS.items()])
    out = shaped(table, column, id_col).select("_conv", F.explode(turns).alias("_t")).select("_conv", F.col("_t.turn").alias("_turn"), F.lower(F.coalesce("_t.role", F.lit(""))).alias("_role"), F.coalesce("_t.text", F.lit("")).alias("_text"))
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return out.withColumn("_role", F.coalesce(F.try_element_at(named, "_role"), "_role"))


def escape(text: str) -> str:
    """One backslash more after the first character of each control string."""
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def write(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans of it that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        parts += [head, body, END]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        yield unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text)


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation of canonical rows: ``_conv, formatted, loss`` (spans of code points).

    Turns are ordered by number, then role and text; repeated rows are repeated turns. Rows with a
    null conversation id are one conversation. An empty table gives an empty result. A conversation
    is one text, so its turns come to one task; texts of several conversations never do.
    """
    ship(turns.sparkSession)
    grouped = turns.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("_turns"))
    schema = T.StructType([grouped.schema["_conv"], T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [write((t["_role"], t["_text"]) for t in x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([[list(s) for s in y] for _, y in done], pa.list_(pa.list_(pa.int64())))], schema.names)

    return grouped.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted texts gives back: counts and digests per conversation."""
    ship(formatted.sparkSession)
    slim = formatted.select("_conv", "formatted", "loss")
    schema = T.StructType([slim.schema["_conv"], *(T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])

    def one(text: str, loss: list[list[int]]) -> tuple:
        own = list(read(text))
        turns = hashlib.sha256()
        for role, body in own:
            turns.update(f"{role}\n{body}\n".encode())
        under = "".join(unescape(text[a:b]) for a, b in loss)
        return len(own), turns.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], schema.names)

    return slim.mapInArrow(run, schema)

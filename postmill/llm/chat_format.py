"""Chat formatting: layouts told apart by a fingerprint of their field paths, turned into canonical turns.

A layout is declared by the field paths it has and by where roles and texts are. The paths of a schema or of a JSON
record that belong to the known vocabulary are sorted and hashed, and the hash selects the declaration; other
fields are ignored, so extra columns do not hide a layout. Everything is built-in expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """``fields``: one role and the paths whose texts it says, per turn. ``turns``: list, role and text field; with it,
    ``fields`` are turns before those of the list, left out where they have no text."""

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turns: tuple[str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _single(name: str, *said: tuple[str, tuple[str, ...]]) -> Layout:
    return Layout(name, tuple(p for _, paths in said for p in paths), fields=said)


def _listed(items: str, role: str, text: str, *beside: str, system: str | None = None) -> Layout:
    said = (("system", (system,)),) if system else ()
    return Layout("_".join((*beside, items)), (*beside, f"{items}[].{role}", f"{items}[].{text}"), fields=said, turns=(items, role, text))


LAYOUTS = (
    _single("prompt_completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _single("prompt_response", ("user", ("prompt",)), ("assistant", ("response",))),
    _single("question_answer", ("user", ("question",)), ("assistant", ("answer",))),
    _single("instruction_output", ("user", ("instruction",)), ("assistant", ("output",))),
    _single("instruction_input_output", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _single("system_prompt_response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    _listed("messages", "role", "content"),
    _listed("conversations", "from", "value"),
    # The prompt repeats the first message.
    _listed("messages", "role", "content", "prompt"),
    _listed("messages", "role", "content", "prompt", "completion"),
    _listed("messages", "role", "content", "prompt", "response"),
    # A system message beside its turns is not among them.
    _listed("messages", "role", "content", "system", system="system"),
    _listed("conversations", "from", "value", "system", system="system"),
)
#: One row per turn.
ROWS = Layout("turn_rows", ("conv_id", "turn", "role", "text"))
BY_FINGERPRINT = {layout.fingerprint: layout for layout in (*LAYOUTS, ROWS)}
KNOWN_PATHS = tuple(sorted({p for layout in BY_FINGERPRINT.values() for p in layout.paths}))

#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "### ", "</turn>\n"


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of the leaves of a schema, ``[]`` for list items."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def _canonical_role(role: Column) -> Column:
    known = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        known = F.when(role == other, name).otherwise(known)
    return known


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_canonical_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns_of(layout: Layout, value, items) -> Column:
    """Canonical turns under ``layout``; ``value(path)`` is a text, ``items(list, role, text)`` an array of both."""
    said = []
    for role, paths in layout.fields:
        parts = [F.when(F.coalesce(value(p), F.lit("")) != "", value(p)) for p in paths]
        said.append(_turn(F.lit(role), F.concat_ws("\n\n", *parts)))
    if not layout.turns:
        return F.array(*said)
    name, role, text = layout.turns
    listed = F.transform(F.filter(items(name, role, text), lambda t: t.isNotNull()), lambda t: _turn(t[role], t[text]))
    return F.concat(F.filter(F.array(*said), lambda t: t["text"] != ""), listed) if said else listed


def turns_from_rows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns, layout)`` from one row per turn, in order of turn, then role and text.

    Rows are gathered per conversation, since a conversation is one record of the result; nothing else meets.
    """
    said = F.struct(F.col(turn).alias("turn"), _canonical_role(F.col(role)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("_said"))
    turns = F.transform("_said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.select("conv_id", turns.alias("turns"), F.lit(ROWS.name).alias("layout"))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", payload: str | None = None) -> DataFrame:
    """``(conv_id, turns, layout)`` of every record.

    Without ``payload`` the layout is that of the table: the fingerprint of its schema's known paths selects it, and
    a schema that matches none is an error. With ``payload``, a column of JSON texts, every record is fingerprinted
    by itself and tables may mix layouts.

    A NULL or empty text is an empty turn, a NULL role an empty role. A record is known by the fields it has, over all
    items of its list; fields that are NULL count where the others alone make no layout. An item that is NULL is no turn.
    A record whose paths match no declaration, or
    that is no JSON, or NULL, keeps its row with layout NULL and no turns. Rows of the ``turn_rows`` layout with
    equal order, role and text are all kept; rows with a NULL conversation id form one conversation with that id.
    Other columns are ignored. An empty table gives an empty result.
    """
    if payload is None:
        paths = {id_col: "conv_id"}.get
        found = [paths(p, p) for p in schema_paths(df.schema)]
        layout = BY_FINGERPRINT.get(fingerprint(set(found) & set(KNOWN_PATHS) - ({"conv_id"} if "turn" not in found else set())))
        if layout is None:
            raise ValueError(f"no layout is declared for the fields {sorted(found)}")
        if layout is ROWS:
            return turns_from_rows(df, id_col)
        turns = _turns_of(layout, lambda p: F.col(p).cast("string"), lambda name, role, text: F.col(name))
        return df.select(F.col(id_col).alias("conv_id"), turns.alias("turns"), F.lit(layout.name).alias("layout"))

    record = F.try_parse_json(F.col(payload))

    def path(p: str) -> str:
        return "$." + p.replace("[]", "[0]")

    def value(p: str) -> Column:
        return F.try_variant_get(F.col("_record"), path(p), "string")

    def items(name: str, role: str, text: str) -> Column:
        return F.try_variant_get(F.col("_record"), f"$.{name}", f"array<struct<`{role}`:string,`{text}`:string>>")

    known = [p for p in KNOWN_PATHS if p not in ROWS.paths]
    lists = sorted({layout.turns[0] for layout in LAYOUTS if layout.turns})
    raw = F.from_json(F.col("_text"), ", ".join(f"`{name}` array<string>" for name in lists))

    def names(name: str) -> Column:
        """Paths of all fields of all items of a list, NULL ones included."""
        fields = F.flatten(F.transform(F.col("_lists")[name], lambda item: F.coalesce(F.json_object_keys(item), F.array().cast("array<string>"))))
        return F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.concat(F.lit(f"{name}[]."), f))

    def print_of(paths: Column) -> Column:
        return F.sha2(F.array_join(F.filter(F.array(*[F.lit(p) for p in known]), lambda p: F.array_contains(paths, p)), "\n"), 256)

    listed = F.concat(*[names(name) for name in lists])
    present = F.concat(F.coalesce(F.json_object_keys("_text"), F.array().cast("array<string>")), listed)
    filled = F.concat(F.array_compact(F.array(*[F.when(value(p).isNotNull(), F.lit(p)) for p in known if "[]" not in p])), listed)
    declared = [layout.fingerprint for layout in LAYOUTS]
    # Fields that are there but NULL count only where the others alone make no layout.
    marked = (
        df.select(F.col(id_col).alias("conv_id"), F.col(payload).alias("_text"), record.alias("_record"))
        .withColumn("_lists", F.when(F.col("_record").isNotNull(), raw))
        .withColumn("_filled", print_of(filled))
        .withColumn("_print", F.when(F.col("_filled").isin(declared), F.col("_filled")).otherwise(print_of(present)))
    )
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in LAYOUTS:
        chosen = F.col("_print") == layout.fingerprint
        name = F.when(chosen, F.lit(layout.name)).otherwise(name)
        turns = F.when(chosen, _turns_of(layout, value, items)).otherwise(turns)
    return marked.select("conv_id", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"), name.alias("layout"))


def escape(text: Column) -> Column:
    """No control string is left in an escaped text: the backslash goes inside it."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    closed = F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(closed, "#(?=##)", "#\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """Add ``segments``, pieces of the output with their loss flag, and ``formatted``, the pieces put together.

    A turn is written as ``### role: text</turn>`` and a line end. Only the texts of assistant turns are under the loss
    mask. A record without turns gives an empty text.
    """

    def said(turn: Column) -> Column:
        role = F.replace(escape(turn["role"]), F.lit(":"), F.lit("\\:"))
        return F.array(
            F.struct(F.concat(F.lit(OPEN), role, F.lit(": ")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), (turn["role"] == "assistant").alias("loss")),
            F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
        )

    segments = turns.withColumn("segments", F.flatten(F.transform("turns", said)))
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")
        ),
    )


def loss_text(segments: Column) -> Column:
    """Text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")

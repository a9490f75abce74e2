"""Chat formatting with DataFrame functions only.

A record's *fingerprint* is a hash of its nested field paths.  It selects a
declarative :class:`Mapping` that turns the record into canonical turns, an
array of (role, text).  A :class:`Template` then writes the turns into one text
with a loss mask, and reads such a text back.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: Elements that a running sum adds one by one; blocks of them are added as wholes.
BLOCK = 256


def let(x: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def running(sizes: Column) -> Column:
    """For each element of an array<bigint> the sum of those before it."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("seen"))

    def sums(x: Column, size) -> Column:
        return F.aggregate(x, zero, lambda done, v: F.struct((done["at"] + size(v)).alias("at"), F.concat(done["seen"], F.array(done["at"])).alias("seen")))

    def blocks(x: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / BLOCK).cast("int"), F.lit(0)))
        return F.transform(first, lambda b: sums(F.slice(x, b * BLOCK + 1, BLOCK), lambda v: v))

    def whole(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, sums(parts, lambda p: p["at"])["seen"], lambda p, before: F.transform(p["seen"], lambda v: v + before)))

    return let(sizes, lambda x: let(blocks(x), whole))


@dataclass(frozen=True)
class Mapping:
    """How records of one layout become turns.

    ``list_path`` with ``role`` and ``text``: the turns are that array's elements.
    ``fixed``: (role, fields) in order; the non-empty fields are joined by a line break.
    ``roles`` renames roles; other roles stay.
    """

    name: str
    paths: tuple[str, ...]
    list_path: str = ""
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), "messages"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", ("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_only", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt_completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("system", "prompt", "response"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def _shape(paths: tuple[str, ...]) -> str:
    """The nested field paths as one text, fields in order of name at each level."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in re.findall(r"[^.\[\]]+|\[\]", path):
            node = node.setdefault(part, {})

    def write(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{write(node['[]'])}>"
        return f"OBJECT<{', '.join(f'{k}: {write(node[k])}' for k in sorted(node))}>" if node else ""

    return write(tree)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    """The fingerprint of records that have exactly these field paths ([] marks array elements)."""
    return hashlib.sha256(_shape(paths).encode()).hexdigest()


def _schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return _schema_paths(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else [at]


def fingerprint(record: Column, kind: T.DataType) -> Column:
    """A struct's fingerprint comes from its type, a JSON text's from each row."""
    if isinstance(kind, T.StructType):
        return F.lit(fingerprint_of(tuple(_schema_paths(kind))))
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.sha2(F.regexp_replace(shape, r"(?<=: |<)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+,\s*\d+\)|DATE|TIMESTAMP|VARIANT)(?=[,>])", ""), 256)


def _turns(record: Column, kind: T.DataType, m: Mapping) -> Column:
    parsed = None if isinstance(kind, T.StructType) else F.try_parse_json(record)

    def get(path: str, as_type: str) -> Column:
        if parsed is not None:
            return F.try_variant_get(parsed, f"$.{path}", as_type)
        value = record
        for part in path.split("."):
            value = value[part]
        return value.cast(as_type) if as_type == "string" else value

    if m.list_path:
        turns = F.transform(get(m.list_path, f"array<struct<`{m.role}`:string,`{m.text}`:string>>"), lambda x: F.struct(x[m.role].alias("role"), x[m.text].alias("text")))
    else:
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[get(f, "string") for f in fields]), lambda x: x != ""), "\n").alias("text")) for role, fields in m.fixed])
    if m.roles:
        renamed = F.create_map(*[F.lit(x) for pair in m.roles for x in pair])
        turns = F.transform(turns, lambda x: F.struct(F.coalesce(F.try_element_at(renamed, x["role"]), x["role"]).alias("role"), x["text"].alias("text")))
    filled = F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return F.filter(filled, lambda x: (x["role"] != "system") | (x["text"] != "")) if m.fixed else filled


def canonical_turns(records: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, turns_col: str = "turns", layout_col: str = "layout") -> DataFrame:
    """``records`` with the turns and the layout's name; both null if no mapping has the record's fingerprint.

    ``record_col`` is a struct (one layout for the table) or a JSON text (a layout
    for each row).  Null roles and texts count as empty; a null, malformed or
    unknown record gets null, never an error; a fixed system turn without text is
    left out.  Input columns stay, but for those named as the outputs.
    """
    kind = records.schema[record_col].dataType
    record, turns, layout = F.col(f"`{record_col}`"), F.lit(None).cast(TURNS), F.lit(None).cast("string")
    print_ = fingerprint(record, kind)
    fixed = fingerprint_of(tuple(_schema_paths(kind))) if isinstance(kind, T.StructType) else None
    for m in reversed(mappings):
        wanted = fingerprint_of(m.paths)
        if fixed in (None, wanted):
            turns = F.when(print_ == wanted, _turns(record, kind, m)).otherwise(turns)
            layout = F.when(record.isNotNull() & (print_ == wanted), m.name).otherwise(layout)
    return records.withColumns({turns_col: F.when(record.isNotNull(), turns), layout_col: layout})


@dataclass(frozen=True)
class Template:
    """Marks turns as ``start role middle text end``.

    Inside roles and texts a backslash is doubled and control strings get one
    after their first character, so no control string of this or the other
    common templates is left, and removing one backslash of each pair or before
    each other character restores the text.
    """

    start: str = "<|start|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    learned: str = "assistant"

    def escape(self, x: Column) -> Column:
        x = F.regexp_replace(x, r"\\", r"\\\\")
        return F.regexp_replace(F.regexp_replace(x, r"<(\||/?s>|</?SYS>>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")

    def unescape(self, x: Column) -> Column:
        return F.regexp_replace(x, r"(?s)\\(.)", "$1")

    def apply(self, turns: Column) -> tuple[Column, Column]:
        """The formatted text, and the loss mask: (start, length, turn) of learned texts in its code points.

        Both take time in proportion to the turns and their texts.
        """
        parts = F.transform(turns, lambda t: F.struct((t["role"] == self.learned).alias("learned"), F.concat(F.lit(self.start), self.escape(t["role"]), F.lit(self.middle)).alias("head"), self.escape(t["text"]).alias("text")))
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["text"], F.lit(self.end))), "")
        sizes = F.transform(parts, lambda p: F.struct(p["learned"].alias("learned"), F.length(p["head"]).cast("long").alias("head"), F.length(p["text"]).cast("long").alias("text")))

        def spans(s: Column) -> Column:
            starts = running(F.transform(s, lambda p: p["head"] + p["text"] + len(self.end)))
            numbered = F.transform(F.arrays_zip(s.alias("s"), starts.alias("at")), lambda x, i: F.struct(x["s"]["learned"].alias("learned"), (x["at"] + x["s"]["head"]).alias("start"), x["s"]["text"].alias("length"), i.alias("turn")))
            return F.transform(F.filter(numbered, lambda x: x["learned"]), lambda x: F.struct(x["start"], x["length"], x["turn"]))

        return text, let(sizes, spans)

    def read(self, text: Column) -> Column:
        """The turns of a formatted text."""
        pieces = F.filter(F.split(text, re.escape(self.end)), lambda p: p != "")

        def turn(p: Column) -> Column:
            halves = F.split(p, re.escape(self.middle))
            return F.struct(self.unescape(F.substring(halves[0], F.lit(len(self.start) + 1), F.length(halves[0]))).alias("role"), self.unescape(halves[1]).alias("text"))

        return F.transform(pieces, turn)

    def learned_text(self, text: Column, spans: Column) -> Column:
        """All text under the loss mask, unescaped, nothing between.

        A span is cut from its own turn's piece, so no span counts from the start of the text.
        """

        def cut(pieces: Column) -> Column:
            starts = running(F.transform(pieces, lambda p: F.length(p).cast("long") + len(self.end)))
            return let(starts, lambda at: F.transform(spans, lambda s: self.unescape(F.substring(pieces[s["turn"]], (s["start"] - at[s["turn"]] + 1).cast("int"), s["length"].cast("int")))))

        return F.array_join(let(F.split(text, re.escape(self.end)), cut), "")


def turn_records(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn -> one record of the ``messages`` layout for each key (null is a key too).

    Turns are in order of (turn, role, text), nulls first, so ties and repeated
    rows have one defined order.  Other columns are ignored.
    """
    message = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = rows.select(F.col(key).alias(key), message.alias("m")).groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("m"))
    return grouped.select(key, F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")).alias("record"))


def pack_json(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """``key``, ``record``: records of the ``messages`` layout as JSON texts of several layouts, as sources with mixed layouts deliver them.

    A user's and an assistant's turn become ``prompt`` and ``completion``; of the
    others, those with an even hash of the key become ``conversations`` (from,
    value), unless a role is itself called human or gpt, and the rest stay
    ``messages``.  Nothing is lost: the mapping that the fingerprint selects gives
    the same turns back.  A JSON text may have 128 MiB (Spark's bound on a variant).
    """
    turns = F.col(f"{record}.messages")
    pair = (F.size(turns) == 2) & (turns[0]["role"] == "user") & (turns[1]["role"] == "assistant")
    named = F.coalesce(F.xxhash64(key) % 2 == 0, F.lit(False)) & ~F.exists(turns, lambda t: t["role"].isin("human", "gpt"))
    said = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    shared = F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(said, t["role"]), t["role"]).alias("from"), t["content"].alias("value")))
    layouts = F.when(pair, F.to_json(F.struct(turns[0]["content"].alias("prompt"), turns[1]["content"].alias("completion")))).when(named, F.to_json(F.struct(shared.alias("conversations"))))
    return records.select(key, layouts.otherwise(F.to_json(record)).alias(record))


def format_chat(records: DataFrame, record_col: str = "record", template: Template = Template(), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with layout, turns, formatted text and loss_mask (all null for unknown records)."""
    known = canonical_turns(records, record_col, mappings)
    text, mask = template.apply(F.col("turns"))
    return known.withColumns({"formatted": text, "loss_mask": mask})


def digests(formatted: DataFrame, key: str = "conv_id", template: Template = Template()) -> DataFrame:
    """What a reader of the formatted texts and masks finds: counts and hashes."""
    back = formatted.select(key, "formatted", template.read(F.col("formatted")).alias("turns"), template.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

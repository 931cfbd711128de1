r"""Operator 5, chat formatting: records of several layouts to canonical turns to one template.

A record's layout is found by its schema fingerprint: the hash of those of its
nested field paths (`outer[].inner.leaf`, over all elements of a list) that any
mapping knows, so other fields may stand beside them. A table of declarative
mappings gives for each known fingerprint the paths that hold roles and texts.
Records are structs, whose paths are those of their type, or JSON text, whose
paths are read from each record; JSON text is bounded by Spark's parser (20
million characters a string, 16 MB a record), structs are not. Records of
unknown layouts and unreadable ones come back with null turns, and
unknown_layouts counts them by their paths. The template writes each turn as
`<|im_start|>role\ntext<|im_end|>\n`; in roles and texts `\`, `<` and (in roles)
line ends are escaped, so that no text can hold a control string and every text
can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Levels of nesting whose field paths a JSON record's fingerprint can see.
DEPTH = 5


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: a list of messages (a path), or single fields in order, each with its role.

    fields: (role, path) or (role, path+path) for texts joined by a line end. Those in optional may be missing; where both a list and
    fields are given, the fields come first. Paths are written with dots.
    """

    messages: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[tuple[str, ...]]:
        """All sets of paths, sorted, that mean this layout."""
        single = [p for _, field in self.fields for p in field.split("+")]
        ground = {p for p in single if p not in self.optional}
        bases = [ground] if self.messages is None else [ground | {self.messages, f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"}, ground | {self.messages}]
        free = [p for p in single if p in self.optional]
        return [tuple(sorted(base.union(more))) for base in bases for n in range(len(free) + 1) for more in combinations(free, n)]


#: The layouts this module knows; others are added by passing a longer tuple. A list without elements has no turns, and what is no list is no layout.
SYSTEM = (("system", "system"),)
LAYOUTS = (
    Layout("messages", "role", "content", fields=SYSTEM, optional=("system",)),
    Layout("turns", "role", "text", fields=SYSTEM, optional=("system",)),
    Layout("conversations", "from", "value", fields=SYSTEM, optional=("system",), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("data.messages", "role", "content"),
    Layout(fields=(*SYSTEM, ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout(fields=(*SYSTEM, ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout(fields=(*SYSTEM, ("user", "instruction+input"), ("assistant", "output")), optional=("system", "input")),
    Layout(fields=(*SYSTEM, ("user", "question"), ("assistant", "answer")), optional=("system",)),
)


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for paths in layout.fingerprints() for p in paths})


def type_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Field paths of a struct type."""
    if isinstance(kind, T.ArrayType):
        return type_paths(kind.elementType, f"{prefix.removesuffix('.')}[].")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in (prefix + f.name, *type_paths(f.dataType, f"{prefix}{f.name}."))]
    return []


def variant_paths(value: Column, depth: int = DEPTH) -> Column:
    """Field paths of a variant, those of a list's elements after `[]`; null or without fields: an empty array."""
    nothing = F.array().cast("array<string>")
    if not depth:
        return nothing
    of_object = F.transform(F.map_entries(value.try_cast("map<string,variant>")), lambda e: F.concat(
        F.array(e["key"]), F.transform(variant_paths(e["value"], depth - 1), lambda p: F.when(p.startswith("["), F.concat(e["key"], p)).otherwise(F.concat(e["key"], F.lit("."), p))),
    ))
    of_list = F.transform(value.try_cast("array<variant>"), lambda e: F.transform(variant_paths(e, depth - 1), lambda p: F.when(p.startswith("["), F.concat(F.lit("[]"), p)).otherwise(F.concat(F.lit("[]."), p))))
    return F.coalesce(F.array_distinct(F.flatten(F.coalesce(of_object, of_list))), nothing)


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those of the paths that a layout knows."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known_paths(layouts))))), "\n"))


def _fingerprint_of(paths: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit("\n".join(paths)))


def _text_of(value: Column) -> Column:
    """Text of a variant: a string or a number itself; of a list of parts the texts of its parts, one after the other; of an object its text or content.

    Parts and objects without these stay as their JSON, so nothing is lost; null is empty.
    """
    def one(v: Column) -> Column:
        inner = F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"), F.to_json(v))
        return F.when(v.isNull() | F.is_variant_null(v), F.lit("")).otherwise(F.when(F.schema_of_variant(v).startswith("OBJECT"), inner).otherwise(F.coalesce(v.try_cast("string"), F.to_json(v))))

    parts = value.try_cast("array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, one), "")).otherwise(one(value))


def _named(role: Column, layout: Layout) -> Column:
    for old, new in layout.roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.coalesce(role, F.lit(""))


def _turns(layout: Layout, get, items, text) -> Column:
    """Turns of a record. get(path): its value; items(path, f): f of each element of its list; text(value): the value as text."""
    out = []
    for role, field in layout.fields:
        parts = [F.coalesce(text(get(p)), F.lit("")) for p in field.split("+")]
        body = parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")
        turn = F.array(F.struct(F.lit(role).alias("role"), body.alias("text")))
        out.append(F.when(body == "", F.array().cast(TURNS)).otherwise(turn) if field in layout.optional else turn)
    if layout.messages:
        out.append(items(layout.messages, lambda m: F.struct(_named(text(m(layout.role)), layout).alias("role"), F.coalesce(text(m(layout.text)), F.lit("")).alias("text"))))
    return F.concat(*out)


def _json_turns(record: Column, layout: Layout) -> Column:
    get = lambda path: F.try_variant_get(record, f"$.{path}", "variant")
    items = lambda path, f: F.transform(F.try_variant_get(record, f"$.{path}", "array<variant>"), lambda m: f(lambda name: F.try_variant_get(m, f"$.{name}", "variant")))
    return _turns(layout, get, items, _text_of)


def _struct_turns(record: Column, kind: T.StructType, layout: Layout) -> Column:
    def get(path: str) -> Column:
        value, own = record, kind
        for name in path.split("."):
            value, own = (value[name], own[name].dataType) if isinstance(own, T.StructType) and name in own.names else (F.lit(None), T.NullType())
        return value

    def text(value: Column) -> Column:
        return value.cast("string")

    def items(path: str, f) -> Column:
        return F.transform(F.coalesce(F.filter(get(path), lambda m: m.isNotNull()), F.array()), lambda m: f(lambda name: m[name]))

    return _turns(layout, get, items, text)


def canonical(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with columns layout (fingerprint) and turns; both replace columns of their names.

    turns is null where no mapping has the fingerprint, or where JSON text is null, no object or beyond the parser's bounds. Extra fields
    are ignored; of two fields of one layout that are both null the record still has that layout. A null struct has null turns.
    """
    kind = records.schema[record_col].dataType
    record = F.col(record_col)
    if isinstance(kind, T.StructType):
        known = set(known_paths(layouts))
        own = tuple(sorted(p for p in type_paths(kind) if p in known))
        layout, turns = _fingerprint_of(own), F.lit(None).cast(TURNS)
        for x in layouts:
            if own in x.fingerprints()[: len(x.fingerprints()) // (2 if x.messages else 1)]:
                turns = F.when(record.isNotNull(), _struct_turns(record, kind, x))
                break
        return records.withColumns({"layout": F.when(record.isNotNull(), layout), "turns": turns})
    value = F.try_parse_json(record)
    layout = F.when(value.isNotNull(), fingerprint(variant_paths(value), layouts))
    turns = F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        for paths in x.fingerprints():
            turns = F.when(F.col("layout") == _fingerprint_of(paths), _json_turns(value, x)).otherwise(turns)
    return records.withColumn("layout", layout).withColumn("turns", turns)


def unknown_layouts(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """How many JSON records have no mapping, by their field paths (null: no readable JSON object): paths, n."""
    odd = canonical(records.select(record_col), record_col, layouts).where("turns is null")
    paths = F.array_join(F.array_sort(variant_paths(F.try_parse_json(F.col(record_col)))), " ")
    return odd.groupBy(F.when(F.try_parse_json(F.col(record_col)).isNotNull(), paths).alias("paths")).agg(F.count("*").alias("n"))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    """Undo escape(): each backslash is followed by its own letter, so the order of these steps is free of doubt."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted text, with the text as it stands there (escaped), its start, in code points, and its length."""
    bodies = F.filter(F.transform(F.split(formatted, r"<\|im_end\|>\n"), lambda p: F.substr(p, F.lit(len(START) + 1))), lambda p: p != "")
    return F.transform(bodies, lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1)).alias("role"),
        F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2).alias("escaped"),
    ))


def loss_spans(turns: Column, trained: str = "assistant") -> Column:
    """Starts and lengths, in code points of the formatted text, of what is under the loss mask: the texts of `trained` turns."""
    sizes = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.length(escape(t["role"], True)).alias("head"), F.length(escape(t["text"])).alias("body")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(START) + t["head"] + 1
        span = F.array(F.struct(start.cast("long").alias("start"), t["body"].cast("long").alias("length")))
        return F.struct((start + t["body"] + len(END)).cast("long").alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, zero, step)["spans"]


def gather(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Flat rows, one a turn, to one record a conversation, a struct of the `messages` layout. Null roles and texts become empty; ties of turn go by role, then text.

    Other columns are ignored; an empty table gives no records. A conversation is one value, whatever its length.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    lists = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("m"))
    return lists.select("conv_id", F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")).alias("record"))


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row per record: id, layout, formatted text and loss spans (array of start, length in code points).

    A record of an unknown layout, or no JSON object, gives null text and spans;
    a conversation without turns an empty text and no spans. Ties and repeated
    records each give their row; other columns are ignored; an empty table gives
    no rows.
    """
    turns = canonical(records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record")), "record", layouts)
    return turns.select("conv_id", "layout", render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per formatted record: what its text and loss spans say, read back from them. A null text gives nulls, an empty one no turns."""
    t = formatted.withColumn("back", F.transform(parse(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), unescape(x["escaped"]).alias("text"))))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return t.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_chats(gather(rows.union(probe))))


OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS masked,
    sum(length(role) + length(text) + 1 + 12 + 11
      + (length(text) - length(replace(replace(text, '<', ''), chr(92), '')))
      + (length(role) - length(replace(replace(replace(role, '<', ''), chr(92), ''), chr(10), '')))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(masked) AS BIGINT) AS loss_chars, sha256(masked) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c
"""

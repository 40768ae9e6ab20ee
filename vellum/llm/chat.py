"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a template renders and reads them back.

A record is a VARIANT. Its nested field paths (types and values left out) are hashed; the hash selects one of the
declared ``LAYOUTS``, which say by paths where the turns are. Records of a layout that isn't declared keep a row with
``layout`` null and no turns; formatted, a conversation without turns is an empty text with nothing under its mask. Everything is built-in Spark functions.

Defined results: null text or role is empty; turns without text are kept; turns of a conversation are ordered by turn
(null first), then role and text, so ties and repeated rows have a fixed place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where turns are. ``items``: path of an array of messages with ``role`` and ``text`` fields; ``fixed``: (role, path) pairs, or
    (None, path, role path) where the role is a field too. ``paths``: the field paths of its records, with optional ones in ``also``."""

    name: str
    paths: str
    items: tuple[str, str, str] | None = None
    fixed: tuple[tuple, ...] = ()
    roles: dict = field(default_factory=dict)


#: Field names and role names of common public layouts. Fields stand in alphabetical order.
LAYOUTS = (
    Layout("turn_row", "{role,text}", fixed=((None, "$.text", "$.role"),)),
    Layout("messages", "{messages:[{content,role}]}", items=("$.messages", "role", "content")),
    Layout("messages_named", "{messages:[{content,name,role}]}", items=("$.messages", "role", "content")),
    Layout("messages_id", "{id,messages:[{content,role}]}", items=("$.messages", "role", "content")),
    Layout("messages_none", "{messages:[]}", items=("$.messages", "role", "content")),
    Layout("share", "{conversations:[{from,value}]}", items=("$.conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("share_id", "{conversations:[{from,value}],id}", items=("$.conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("share_none", "{conversations:[]}", items=("$.conversations", "from", "value")),
    Layout("instruction", "{instruction,output}", fixed=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", "{input,instruction,output}", fixed=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("prompt", "{completion,prompt}", fixed=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_system", "{prompt,response,system}", fixed=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("prompt_response", "{prompt,response}", fixed=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question", "{answer,question}", fixed=(("user", "$.question"), ("assistant", "$.answer"))),
)


def field_paths(record: Column) -> Column:
    """The nested field names of a variant as text, such as ``{messages:[{content,role}]}``."""
    text = F.schema_of_variant(record)
    for pattern, to in ((r"ARRAY<VOID>", "[>"), (r"OBJECT<", "{"), (r"ARRAY<", "["), (r": (VOID|STRING|BIGINT|DOUBLE|BOOLEAN|DATE|TIMESTAMP(_NTZ)?|FLOAT|BINARY|VARIANT|DECIMAL\(\d+, ?\d+\))", "")):
        text = F.regexp_replace(text, pattern, to)
    # what closes: each > after an array's element is ], after an object's fields }
    text = F.regexp_replace(text, ", ", ",")
    text = F.regexp_replace(text, ": ", ":")
    return F.regexp_replace(F.regexp_replace(text, ">>>", "}]}"), ">", "}")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(_normal(field_paths(record)))


def _normal(paths: Column) -> Column:
    """Closing marks carry no information that the opening ones lack; without them all forms of closing agree."""
    return F.regexp_replace(paths, r"[}\]]+", ";")


def _mapped_role(layout: Layout, role: Column) -> Column:
    out = role
    for old, new in layout.roles.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _turns_of(layout: Layout, record: Column) -> Column:
    if layout.items:
        path, role, text = layout.items
        items = F.variant_get(record, path, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda m: F.struct(_mapped_role(layout, m[role]).alias("role"), m[text].alias("text")))
    turns = []
    for spec in layout.fixed:
        role = F.lit(spec[0]) if spec[0] is not None else F.variant_get(record, spec[2], "string")
        turns.append(F.struct(_mapped_role(layout, role).alias("role"), F.variant_get(record, spec[1], "string").alias("text")))
    return F.array(*turns)


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` (name or null) and ``turns`` (array of role and text) by the fingerprint of the variant column ``record``."""
    mark, name, turns = fingerprint(F.col(record)), F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in reversed(layouts):
        hit = F.col("__fingerprint") == F.xxhash64(_normal(F.lit(layout.paths)))
        name, turns = F.when(hit, F.lit(layout.name)).otherwise(name), F.when(hit, _turns_of(layout, F.col(record)).cast(TURNS)).otherwise(turns)
    return df.withColumn("__fingerprint", mark).withColumns({"layout": name, "turns": turns}).drop("__fingerprint")


@dataclass(frozen=True)
class Template:
    """``begin role middle text end`` for each turn. ``controls`` are escaped inside roles and texts: a backslash and ``e`` go
    behind a control string's first character, and a backslash is doubled, which ``unescape`` undoes."""

    begin: str = "<s>[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    #: Control strings of this and other common templates.
    controls: str = r"/?s>|/?INST\]|<SYS>>|</SYS>>|\|[A-Za-z_]+\|>"

    def escape(self, text: Column) -> Column:
        doubled = F.regexp_replace(text, r"\\", r"\\\\")
        return F.regexp_replace(doubled, rf"([<\[])(?={self.controls})", r"$1\\e")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"\\(?:(\\)|e)", "$1")


def format_rows(rows: DataFrame, template: Template = Template(), trained: str = "assistant") -> DataFrame:
    """One row a conversation from rows (conv_id, turn, at, role, text; at null: no turn): ``formatted`` and ``loss_mask``, the spans (start, length in
    code points of ``formatted``) of the texts of the role that is trained."""
    role, text = template.escape(F.coalesce("role", F.lit(""))), template.escape(F.coalesce("text", F.lit("")))
    rows = rows.select(
        "conv_id", "turn", "at", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit(template.begin), role, F.lit(template.middle)).alias("head"), text.alias("body"),
    )
    said = F.col("at").isNotNull()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "at", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("body")
    rows = rows.withColumns({
        "upto": F.sum(F.when(said, F.char_length("head") + n + len(template.end)).otherwise(0)).over(order).cast("long"),
        "place": F.row_number().over(order),
    })
    start = F.col("upto") - len(template.end) - n
    turn = F.struct("place", F.concat("head", "body", F.lit(template.end)).alias("piece"), F.when(F.col("role") == trained, F.struct(start.alias("start"), n.cast("long").alias("length"))).alias("span"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(said, turn))).alias("t"))
    return out.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, unescaped."""
    quote = lambda s: "\\Q" + s + "\\E"
    pieces = F.filter(F.split(formatted, quote(template.end)), lambda p: p != "")
    body = lambda p: F.split(F.substr(p, F.lit(len(template.begin) + 1)), quote(template.middle), 2)
    return F.transform(pieces, lambda p: F.struct(template.unescape(body(p)[0]).alias("role"), template.unescape(body(p)[1]).alias("text")))


def masked_text(formatted: Column, mask: Column, template: Template = Template()) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return template.unescape(F.array_join(F.transform(mask, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))


def format_records(records: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation from (conv_id, turn, record): each record's fingerprint selects its mapping, and its turns follow those of the records before it."""
    rows = canonical_turns(records, "record").select("conv_id", "turn", F.posexplode_outer("turns").alias("at", "t"))
    return format_rows(rows.select("conv_id", "turn", "at", "t.role", "t.text"), template)


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``conversations`` has a row a turn (conv_id, turn, role, text), each a record of its own."""
    return format_records(conversations.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record")), template)


#: The query's digests in DuckDB's SQL.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|<SYS>>|</SYS>>|\|[A-Za-z_]+\|>)', '<\\e\1', 'g'), '\[(/?INST\])', '[\\e\1', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + length(role) + length('<s>[INST]') + length('[/INST]') + length('</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

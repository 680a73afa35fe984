"""Chat formatting in native expressions: schema fingerprints select declarative mappings into canonical turns.

A layout is known by the SHA-256 of its nested field paths, in order of name
and without types (`messages[].role` is a field of an array's elements).
MAPPINGS says for each known set of paths where the turns stand; a table's
columns and a JSON record in a string column are fingerprinted alike. Fields
whose names no mapping has (an id, a source, scores) don't count. Conversations of all
layouts become (conv_id, turns array<struct<role, text>>), are written with
one template, and can be read back from it without loss.

Template: every turn is START role SEP text END. Inside roles and texts a
backslash is doubled, and one is put after the first character of each control
string, of this template or of others; taking one backslash away before any
character undoes both.

Cases: null texts and roles count as empty; rows of a conversation are put in
order of turn, then role, then text, null first, so that ties and repeated
rows have one order; a null conv_id is a conversation of its own; records of
an unknown layout, and what isn't JSON, have null turns and can be listed by
their fingerprint; an empty table gives an empty table; further columns of a
table and further fields of records and of their turns are passed over.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from linecue.llm.common import table

START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
#: Never left standing inside a text: this template's marks and those of common others.
CONTROL = [START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
TURNS = "array<struct<role:string,text:string>>"
#: Depth to which fields that no mapping knows may be nested.
LEVELS = 4


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout stand.

    rows: the columns (role, text) of a table with a row a turn.
    each: (array, role, text) for a record with an array of turns.
    fields: (role, path) pairs for a record with a field a turn; empty ones are left out.
    roles: other names of roles, to the canonical ones.
    """

    paths: tuple[str, ...]
    rows: tuple[str, str] | None = None
    each: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))
MAPPINGS = [
    Mapping(("conv_id", "role", "text", "turn"), rows=("role", "text")),
    Mapping(("messages[].content", "messages[].role"), each=("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=SPEAKERS),
    Mapping(("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("chosen", "prompt", "rejected"), fields=(("user", "prompt"), ("assistant", "chosen"))),
    Mapping(("input", "instruction", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("instruction", "response"), fields=(("user", "instruction"), ("assistant", "response"))),
    Mapping(("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
]


def shape(paths) -> str:
    """Field paths as one nested text: OBJECT<a, b: ARRAY<OBJECT<c, d>>>, names in order."""
    below: dict[str, list[str]] = {}
    for p in paths:
        head, _, tail = p.partition(".")
        below.setdefault(head, []).extend([tail] if tail else [])
    fields = []
    for head in sorted(below, key=lambda h: h.removesuffix("[]")):
        inner = shape(below[head]) if below[head] else ""
        inner = f"ARRAY<{inner}>" if head.endswith("[]") else inner
        fields.append(head.removesuffix("[]") + (f": {inner}" if inner else ""))
    return f"OBJECT<{', '.join(fields)}>"


def fingerprint(paths) -> str:
    return hashlib.sha256(shape(paths).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def field_paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, leaves only."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


#: Names of fields that mappings of records know.
FIELDS = sorted({part.removesuffix("[]") for m in MAPPINGS if not m.rows for p in m.paths for part in p.split(".")})


def json_fingerprint(record: Column) -> Column:
    """Fingerprint of a JSON record's field paths, those of FIELDS; null if it is no JSON object."""
    found = F.schema_of_variant(F.try_parse_json(record))
    leaf = r"[A-Z_]+(?:\([0-9, ]+\))?"
    paths = F.regexp_replace(F.regexp_replace(found, f": {leaf}(?=[,>])", ""), f"ARRAY<{leaf}>", "ARRAY<>")
    other = rf"(?<=[< ])(?!(?:{'|'.join(FIELDS)})[,>:])[^<>,: ]+(?:: (?:OBJECT<>|ARRAY<>|ARRAY<OBJECT<>>))?(?=[,>])"
    for _ in range(LEVELS):  # from the innermost fields outwards
        paths = F.regexp_replace(F.regexp_replace(paths, other, ""), "(?<=<)(?:, )+|(?:, )+(?=[,>])", "")
    return F.when(found.startswith("OBJECT<"), F.sha2(paths, 256))


def _role(role: Column, mapping: Mapping) -> Column:
    role = F.coalesce(role, F.lit(""))
    for other, canonical in mapping.roles:
        role = F.when(role == other, canonical).otherwise(role)
    return role


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns_of_array(record: Column, mapping: Mapping) -> Column:
    array, role, text = mapping.each
    parsed = F.from_json(record, f"struct<`{array}`:array<struct<`{role}`:string,`{text}`:string>>>")
    return F.transform(parsed[array], lambda e: _turn(_role(e[role], mapping), e[text]))


def turns_of_json(record: Column, found: Column) -> Column:
    """Canonical turns of a JSON record whose fingerprint is `found`; null where no mapping is known."""
    out = F.lit(None).cast(TURNS)
    for key, m in BY_FINGERPRINT.items():
        if m.each:
            turns = _turns_of_array(record, m)
        elif m.fields:
            every = F.array(*(_turn(F.lit(r), F.get_json_object(record, f"$.{p}")) for r, p in m.fields))
            turns = F.filter(every, lambda t: (t["text"] != "") | (t["role"] == "assistant"))
        else:
            continue
        out = F.when(found == key, turns).otherwise(out)
    return out


def from_json(df: DataFrame, record: str, key: str = "conv_id") -> DataFrame:
    """(key, fingerprint, turns) of every record."""
    found = df.select(F.col(key), F.col(record).alias("record"), json_fingerprint(F.col(record)).alias("fingerprint"))
    return found.select(key, "fingerprint", turns_of_json(F.col("record"), F.col("fingerprint")).alias("turns"))


def from_rows(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, fingerprint, turns) of a table with a row a turn, by the mapping that its fingerprint selects."""
    given = set(field_paths(df.schema))
    mapping = max((m for m in MAPPINGS if m.rows and given.issuperset(m.paths)), key=lambda m: len(m.paths), default=None)
    if mapping is None:
        raise ValueError(f"no mapping for rows of the fields {sorted(given)}")
    found = fingerprint(mapping.paths)
    role, text = mapping.rows
    turn = F.struct(F.col(order).alias("at"), _role(F.col(role), mapping).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    return rows.select(key, F.lit(found).alias("fingerprint"), F.transform("rows", lambda r: F.struct(r["role"], r["text"])).alias("turns"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\((?s).)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations with `formatted` and `loss`, the spans (first, chars) of assistant texts in it, from 0.

    Records without turns (of unknown layouts) keep null in both.
    """
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    out = conversations.withColumn("parts", parts)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,chars:int>>").alias("spans"))

    def step(acc, p):
        first = acc["at"] + F.length(p["head"])
        span = F.struct(first.alias("first"), F.length(p["body"]).alias("chars"))
        return F.struct((first + F.length(p["body"]) + len(END)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return out.withColumns({"formatted": formatted, "loss": F.aggregate("parts", zero, step, lambda acc: acc["spans"])}).drop("parts")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation."""
    each = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda x: x != "")
    part = lambda x, n: unescape(F.get(F.split(x, r"\Q" + SEP + r"\E", 2), F.lit(n)))
    return F.transform(each, lambda x: F.struct(part(F.substr(x, F.lit(len(START) + 1)), 0).alias("role"), part(x, 1).alias("text")))


def digests(conversations: DataFrame) -> DataFrame:
    """What the query returns, all of it read from `formatted` and `loss`."""
    out = conversations.select("conv_id", "formatted", "loss", read_back(F.col("formatted")).alias("back"))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["first"] + 1, s["chars"]))), "")
    every = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumns({"masked": masked, "every": every})
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2("every", 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    turns = "array(struct('user' AS from, probe AS value, 0 AS rank), struct('assistant' AS from, probe AS value, 1 AS rank))"
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(PROBE).alias("probe")).select("conv_id", F.expr(f"to_json(struct('probe' AS source, {turns} AS conversations))").alias("record"))
    rows = from_rows(table(spark, sf_dir, "conversations"))
    return digests(format_turns(rows.unionByName(from_json(probe, "record"))))


def _sql_escape(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for mark in CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return text


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
parts AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS masked,
    sum(length('{START}{SEP}{END}') + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(every) AS turns_sha256, length(masked)::BIGINT AS loss_chars,
  sha256(masked) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM parts"""

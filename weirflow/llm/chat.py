"""Chat formatting with DataFrame functions only.

Layouts. Rows of conversations come in many shapes: a prompt and a response, an instruction
with an input and an output, a list of messages with a role and a content (or a "from" and a
"value"), one row for each turn. Every nested field of a layout has a path ("messages[].role");
a layout's fingerprint is the set of the hashes of its paths. LAYOUTS says for each fingerprint
how its fields become turns. The layout with the most paths among those whose paths are all
there is taken, of several the first in LAYOUTS; other fields, also of clashing names, are not
looked at. `turn_rows` reads the paths from a DataFrame's schema and refuses one that fits no
layout; `turns_of_json` reads them from each row of a JSON column.

Template. A turn is "<turn:ROLE>", a line break, the text, a line break, "</turn>" and a line
break. In roles and texts a backslash is written as "\\e" and "<" as "\\l", in roles also ">" as
"\\g"; so no text can hold a mark of the template, and reading it back gives each text exactly.
The loss mask is a list of spans [start, end) of code points of the formatted text: the text of
each assistant's turn, without marks.

Defined results: null roles and texts are empty; rows without a conversation's id form one
conversation without id; turns are ordered by turn, then role, then text, and repeated rows
stay; in other layouts, messages that are null and parts that are null or empty are no turns,
and a row without turns has an empty list; rows that fit no layout have a null list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layouts: name, and for each turn the role and the path of its text; or the path of a list with the names of its fields; or the columns of one row a turn.
LAYOUTS: dict[str, dict] = {
    "prompt_response": {"parts": [("user", "prompt"), ("assistant", "response")]},
    "system_prompt_response": {"parts": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "prompt_completion": {"parts": [("user", "prompt"), ("assistant", "completion")]},
    "question_answer": {"parts": [("user", "question"), ("assistant", "answer")]},
    "instruction_output": {"parts": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input_output": {"parts": [("user", "instruction"), ("user", "input"), ("assistant", "output")], "joined": True},
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "conversations": {"list": "conversations", "role": "from", "text": "value"},
    "turn_rows": {"rows": ("conv_id", "turn", "role", "text")},
    "message_rows": {"rows": ("thread_id", "position", "author", "body"), "renamed": True},
}

#: Other names of roles, which layouts with roles of their own use; in rows of turns a role stays as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LOSS_ROLE = "assistant"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def paths(layout: dict) -> list[str]:
    """The field paths of a layout."""
    if "parts" in layout:
        return [p for _, p in layout["parts"]]
    if "rows" in layout:
        return list(layout["rows"])
    return [layout["list"], *(f"{layout['list']}[].{layout[k]}" for k in ("role", "text"))]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All nested field paths of a schema."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for field in kind.fields:
        own = f"{at}.{field.name}" if at else field.name
        out += [own, *schema_paths(field.dataType, own)]
    return out


def path_hash(path: str) -> int:
    """The hash of one path, as F.xxhash64 gives it."""
    import xxhash

    h = xxhash.xxh64_intdigest(path, 42)
    return h - (1 << 64) if h >> 63 else h


def fingerprint(layout: dict) -> frozenset[int]:
    return frozenset(map(path_hash, paths(layout)))


def layout_of(found: list[str]) -> str | None:
    """The layout for the paths of a schema."""
    hashes = set(map(path_hash, found))
    fits = [(len(mark), -k, name) for k, (name, layout) in enumerate(LAYOUTS.items()) if (mark := fingerprint(layout)) <= hashes]
    return max(fits)[2] if fits else None


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def renamed(role: Column) -> Column:
    out = role
    for other, name in ROLES.items():
        out = F.when(role == other, F.lit(name)).otherwise(out)
    return out


def mapped(layout: dict, get) -> Column:
    """The list of turns of a layout whose conversation is one row. get: a path's column."""
    if "list" in layout:
        some = F.filter(get(layout["list"]), lambda m: m.isNotNull())
        return F.transform(some, lambda m: turn(renamed(m[layout["role"]]), m[layout["text"]]))
    parts = [(role, get(p).cast("string")) for role, p in layout["parts"]]
    if layout.get("joined"):
        joined = F.concat_ws("\n\n", *(F.when(c != "", c) for r, c in parts if r == "user"))
        parts = [("user", joined), *(x for x in parts if x[0] != "user")]
    return F.filter(F.array(*(turn(F.lit(role), c) for role, c in parts)), lambda t: t["text"] != "")


def turns_of(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: from a DataFrame in any of the layouts that hold a conversation in a row."""
    name = layout_of(schema_paths(df.schema))
    if name is None or "rows" in LAYOUTS[name]:
        raise ValueError(f"no layout with a conversation in a row has the paths {schema_paths(df.schema)}")
    return df.select(F.col(key), mapped(LAYOUTS[name], F.col).alias("turns"))


def turns_of_json(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, layout, turns: each row of a JSON column by its own layout."""
    own = F.col(json)
    keys = F.coalesce(F.json_object_keys(own), F.array().cast("array<string>"))

    def inner_paths(name: str) -> Column:
        found = F.coalesce(F.json_object_keys(F.get_json_object(own, f"$.{name}[0]")), F.array().cast("array<string>"))
        return F.transform(found, lambda k: F.concat(F.lit(f"{name}[]."), k))

    inner = [inner_paths(x["list"]) for x in LAYOUTS.values() if "list" in x]
    hashes = F.transform(F.concat(keys, *inner), lambda p: F.xxhash64(p))
    layouts = sorted(((n, x) for n, x in reversed(LAYOUTS.items()) if "rows" not in x), key=lambda x: len(paths(x[1])))
    chosen, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, layout in layouts:  # those with more paths last, and of equals the first listed: they win
        fits = F.size(F.array_intersect(F.col("_hashes"), F.array(*map(F.lit, sorted(fingerprint(layout)))))) == len(fingerprint(layout))
        if "list" in layout:
            kind = T.StructType([T.StructField(layout["list"], T.ArrayType(T.StructType([T.StructField(layout[k], T.StringType()) for k in ("role", "text")])))])
            made = mapped(layout, lambda p, k=kind: F.from_json(own, k)[p])
        else:
            made = mapped(layout, lambda p: F.get_json_object(own, f"$.{p}"))
        chosen, turns = F.when(fits, F.lit(name)).otherwise(chosen), F.when(fits, made).otherwise(turns)
    return df.withColumn("_hashes", hashes).select(F.col(key), chosen.alias("layout"), turns.alias("turns"))


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def rows_of(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The rows of turns, one for each: key, turn, role, text."""
    return turns.select(key, F.posexplode("turns").alias("turn", "t")).select(key, "turn", "t.role", "t.text")


def turn_rows(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text: one row for each turn, from a DataFrame in any of the layouts. key: the conversation's column where the layout names none."""
    name = layout_of(schema_paths(df.schema))
    if name and "rows" in LAYOUTS[name]:
        conversation, turn_at, role, text = map(F.col, LAYOUTS[name]["rows"])
        return df.select(conversation.alias("conv_id"), turn_at.cast("long").alias("turn"), (renamed(role) if LAYOUTS[name].get("renamed") else role).alias("role"), text.alias("text"))
    return rows_of(turns_of(df, key), key).select(F.col(key).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def format_rows(given: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, formatted, loss_spans: one row a conversation, from the rows of turn_rows().

    Positions are running sums over the turns, so long conversations take time in proportion to
    their length. All turns of one conversation meet in one task, since its text is one value.
    """
    head, body, tail = F.concat(F.lit("<turn:"), escaped(F.col("role"), True), F.lit(">\n")), escaped(F.col("text")), F.lit("\n</turn>\n")
    marked = given.select(key, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = marked.select(key, "turn", "role", "text", F.concat(head, body, tail).alias("piece"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"))
    order = Window.partitionBy(key).orderBy("turn", "role", "text")
    placed = marked.withColumn("at", F.row_number().over(order)).withColumn("start", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece") + F.col("head"))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("at"), F.col("start"), (F.col("start") + F.col("body")).alias("end")))
    out = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("spans"))
    return out.select(key, "n_turns", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: a list of role and text."""
    parts = F.split(formatted, "\n</turn>\n")
    some = F.slice(parts, F.lit(1), F.size(parts) - 1)
    after = len("<turn:") + 1
    return F.transform(some, lambda p: F.struct(unescaped(F.substring_index(p, ">", 1).substr(F.lit(after), F.length(p))).alias("role"), unescaped(p.substr(F.locate(">\n", p) + 2, F.length(p))).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")

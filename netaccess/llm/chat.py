"""Chat formatting by schema fingerprints; native expressions only.

Conversations come in many layouts: rows of turns, prompt and response, instruction, input and output,
message arrays under various names. A layout is recognised by its fingerprint, the hash of its sorted
nested field paths, and each known fingerprint selects a declarative mapping to canonical turns
(role, text). A table of several layouts (a union of sources by column name) has a fingerprint for each
row, from the columns that the row fills; so has a column of JSON text. Canonical turns are rendered by a
template whose control strings cannot occur in escaped text.

Escapes: a backslash is written ``\\s``, ``<|`` is written ``\\b`` and, in roles only, a newline is
written ``\\n``. Every backslash of an escaped text thus stands before s, b or n, so reading back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"

#: Layouts as sorted field paths, and the mapping to turns as (role, path of the text) or
#: (array, role path, text path). Extra fields don't belong to a layout and are left out beforehand. A
#: table of rows of turns is gathered to ``turns`` first.
MAPPINGS = {
    ("prompt", "response"): [("user", "prompt"), ("assistant", "response")],
    ("completion", "prompt"): [("user", "prompt"), ("assistant", "completion")],
    ("answer", "question"): [("user", "question"), ("assistant", "answer")],
    ("instruction", "output"): [("user", "instruction"), ("assistant", "output")],
    ("input", "instruction", "output"): [("user", "instruction+input"), ("assistant", "output")],
    ("prompt", "response", "system"): [("system", "system"), ("user", "prompt"), ("assistant", "response")],
    ("messages[].content", "messages[].role"): ("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): ("conversations", "from", "value"),
    ("turns[].role", "turns[].text"): ("turns", "role", "text"),
}
#: Names of roles where an array says whom a turn is ``from``; arrays with a ``role`` keep theirs.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = sorted({p for paths in MAPPINGS for p in paths})
TURNS = "array<struct<role:string,text:string>>"


def escaped(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\b"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\n"), F.lit("\n")) if role else c
    return F.replace(F.replace(c, F.lit("\\b"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def rendered(role: Column, text: Column) -> Column:
    """One turn; null role and text are empty."""
    empty = F.lit("")
    return F.concat(F.lit(START), escaped(F.coalesce(role, empty), True), F.lit("\n"), escaped(F.coalesce(text, empty)), F.lit(END))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    one = F.transform(
        F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda x: x != ""),
        lambda x: F.struct(
            unescaped(F.substring_index(x, "\n", 1).substr(F.lit(len(START) + 1), F.length(x)), True).alias("role"),
            unescaped(x.substr(F.instr(x, "\n") + 1, F.length(x))).alias("text"),
        ),
    )
    return F.when(formatted == "", F.array().cast(TURNS)).otherwise(one)


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type, arrays as []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths) -> Column:
    """Hash of an array column of field paths, in sorted order and without those that no layout has."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, KNOWN)))), "\x1f"))


def _literal(paths: tuple[str, ...]) -> Column:
    return fingerprint(F.array(*map(F.lit, paths)))


def json_paths(c: Column) -> Column:
    """Field paths of a JSON object to the second level, where the fields of an array's first element count."""
    def below(key: Column) -> Column:
        value = F.call_function("get_json_object", c, F.concat(F.lit("$['"), key, F.lit("']")))
        first = F.get_json_object(value, "$[0]")
        inner = lambda v, dot: F.transform(F.json_object_keys(v), lambda x: F.concat(key, F.lit(dot), x))
        return F.coalesce(F.when(value.startswith("["), inner(first, "[].")), F.when(value.startswith("{"), inner(value, ".")), F.array(key))

    return F.coalesce(F.flatten(F.transform(F.json_object_keys(c), below)), F.array().cast("array<string>"))


def _role(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(c)), c)


def _turns(mapping, get, elements) -> Column:
    if isinstance(mapping, tuple):
        array, role, text = mapping
        name = _role if role == "from" else lambda c: c
        return F.transform(elements(array, role, text), lambda x: F.struct(name(x[role]).alias("role"), x[text].alias("text")))
    made = []
    for role, path in mapping:
        fields = [get(p) for p in path.split("+")]
        made.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.when(f != "", f) for f in fields] if len(fields) > 1 else fields).alias("text")))
    return F.array(*made)


def filled_paths(df: DataFrame) -> Column:
    """Known field paths of the columns that a row fills (not null), as an array."""
    parts = []
    for f in df.schema.fields:
        known = [p for p in paths_of(T.StructType([f])) if p in KNOWN]
        if known:
            parts.append(F.when(F.col(f"`{f.name}`").isNotNull(), F.array(*map(F.lit, known))).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")


def layout(df: DataFrame, column: str | None = None) -> Column:
    """Column expression: the fingerprint of each row, of JSON text in ``column`` or of the table's own columns."""
    return fingerprint(filled_paths(df) if column is None else json_paths(F.col(column)))


def canonical(df: DataFrame, column: str | None = None, found: Column | None = None) -> Column:
    """Column expression: the canonical turns of each row of ``df``.

    With ``column``, that column holds JSON text of any known layout; else the columns that a row fills are
    its layout, so a table may hold several. Columns that no layout has count for nothing, whatever their
    names. Roles are kept; names in ``ROLES`` are translated where the layout has ``from``. Null where no mapping has the fingerprint (unknown
    layout, null or broken JSON). ``found`` is the fingerprint where a column has it already.
    """
    found, out = layout(df, column) if found is None else found, F.lit(None).cast(TURNS)
    if column is None:
        own = {p for p in paths_of(df.schema) if p in KNOWN}
        get, parts = (lambda p: F.col(p)), (lambda a, r, t: F.col(a))
    else:
        own, c = set(KNOWN), F.col(column)
        get = lambda p: F.get_json_object(c, f"$.{p}")
        parts = lambda a, r, t: F.from_json(F.get_json_object(c, f"$.{a}"), f"array<struct<`{r}`:string,`{t}`:string>>")
    for paths, mapping in MAPPINGS.items():
        if own.issuperset(paths):  # others cannot occur in this table
            out = F.when(found == _literal(paths), _turns(mapping, get, parts)).otherwise(out)
    return out


def formatted(turns: Column) -> Column:
    """Canonical turns to one string; null turns (no layout known) stay null."""
    return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")


def gathered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns to one row for each conversation: conv and ``turns``, the layout of arrays of role and text.

    Turns go by number, null first; equal numbers by role, then text; repeated rows are turns of their
    own. Null roles and texts are empty. A null conversation id is a conversation. Other columns are left
    out. A conversation is one row from here on, so it is held whole, however long.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv).alias("c"), F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).alias("x"))
    got = turns.groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return got.select(F.col("c").alias(conv), F.transform("x", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator: later expressions read their values instead of repeating them in the plan."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", one.alias("__once")).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__once.{n}") for n in columns])


def with_format(df: DataFrame, turns: Column, role: str = "assistant") -> DataFrame:
    """Adds formatted and loss_spans to ``df``, from canonical turns.

    loss_spans are (turn, start, end) for each turn of ``role``: the code points of its text, end exclusive,
    counted from where the turn starts in ``formatted``. Turns that are null (no layout known) give nulls.
    """
    spans = F.filter(
        F.transform(
            turns,
            lambda t, i: F.struct(
                i.alias("turn"),
                F.length(F.concat(F.lit(START), escaped(F.coalesce(t["role"], F.lit("")), True), F.lit("\n"))).alias("start"),
                (F.length(rendered(t["role"], t["text"])) - len(END)).alias("end"),
                (F.coalesce(t["role"], F.lit("")) == role).alias("on"),
            ),
        ),
        lambda s: s["on"],
    )
    return once(df, formatted=formatted(turns), loss_spans=F.transform(spans, lambda s: F.struct(s["turn"], s["start"], s["end"])))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss spans, read from the formatted string: each once, in order, nothing between."""
    pieces = F.split(formatted, r"\Q" + END + r"\E")
    one = lambda s: unescaped(F.get(pieces, s["turn"]).substr(s["start"] + F.lit(1), s["end"] - s["start"]))
    return F.array_join(F.transform(spans, one), "")


def format_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations kept as rows of turns: conv, formatted and loss_spans; see ``gathered`` and ``with_format``."""
    got = gathered(rows, conv, turn, role, text)
    return with_format(once(got.select(conv, "turns"), c=canonical(got.select("turns"))), F.col("c")).select(conv, "formatted", "loss_spans")


#: What a conversation is in another layout, by the roles of its turns: (roles, columns of the texts).
FLAT = [(("user", "assistant"), ("prompt", "response")), (("system", "user", "assistant"), ("system", "prompt", "response"))]


def in_layouts(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations of ``gathered`` as a table of several layouts: what fits one is moved to it, the rest stays.

    A user's and an assistant's turn become prompt and response, with a system turn before them also that;
    longer ones of these roles alone become conversations (from, value) under other names of the roles; what
    starts with a system turn becomes messages (role, content). All else, and every other role, stays in turns.
    """
    roles = F.transform("turns", lambda t: t["role"])
    names = lambda rs: F.array(*map(F.lit, rs))
    kind = F.lit("turns")
    plain = ~F.exists(roles, lambda r: ~r.isin("user", "assistant"))
    kind = F.when(plain & (F.size("turns") > 2), F.lit("conversations")).otherwise(kind)
    kind = F.when((F.get("turns", F.lit(0))["role"] == "system") & (F.size("turns") > 3), F.lit("messages")).otherwise(kind)
    for i, (rs, _) in enumerate(FLAT):
        kind = F.when(roles == names(rs), F.lit(f"flat{i}")).otherwise(kind)
    df = once(turns, k=kind)
    other = F.create_map(*[F.lit(x) for kv in (("user", "human"), ("assistant", "gpt")) for x in kv])
    at = lambda i: F.get("turns", F.lit(i))["text"]
    columns = {
        "conversations": F.when(F.col("k") == "conversations", F.transform("turns", lambda t: F.struct(F.element_at(other, t["role"]).alias("from"), t["text"].alias("value")))),
        "messages": F.when(F.col("k") == "messages", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))),
    }
    for i, (_, texts) in enumerate(FLAT):
        for j, name in enumerate(texts):
            columns[name] = F.when(F.col("k") == f"flat{i}", at(j)).otherwise(columns.get(name, F.lit(None).cast("string")))
    kept = F.when(F.col("k") == "turns", F.col("turns"))
    return df.select(conv, *[c.alias(n) for n, c in columns.items()], kept.alias("turns"))

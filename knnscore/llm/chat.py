"""Chat formatting by a finite-state machine over roles and a declarative template (native).

A conversation's rows, by turn, become text segments with a loss flag each: a header, the escaped
text, a terminator. The machine walks the roles and reports whether the order is valid and the first
turn that breaks it; a conversation with an invalid order is formatted all the same. Control strings
inside texts and roles are escaped so that none is left in the formatted text but the template's own;
`parse` and `unescape` invert that exactly.

Null text and null role count as empty. Rows that tie in turn are ordered by role, then text; repeated
rows are turns of their own. A null turn comes first. Rows without conv_id form one conversation. Empty
input gives an empty result. Other columns are not read. A conversation is one value in one row (its
digest needs that), so it must fit a string's 2 GB.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    mark: str = "### "
    after: str = ": "
    end: str = "</turn>\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple = ("assistant",)
    #: control string -> letter that stands for it after a backslash
    controls: dict = field(default_factory=lambda: {"### ": "h", "</turn>": "e"})
    #: state -> {role: next state}; a conversation starts in "start" and may end in `final`
    machine: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"},
    })
    final: tuple = ("assistant",)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in template.controls.items():
        out = F.replace(out, F.lit(control), F.lit(f"\\{letter}"))
    return out


def unescape(text: Column, template: Template) -> Column:
    def plain(part: Column) -> Column:
        for control, letter in template.controls.items():
            part = F.replace(part, F.lit(f"\\{letter}"), F.lit(control))
        return part

    # doubled backslashes pair up from the left, as they were written
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _label(role: Column, template: Template) -> Column:
    named = F.create_map(*[F.lit(x) for pair in template.labels.items() for x in pair])
    other = F.concat(F.lit("="), F.replace(escape(role, template), F.lit(":"), F.lit("\\c")))
    return F.coalesce(F.try_element_at(named, role), other)


def _role(label: Column, template: Template) -> Column:
    named = F.create_map(*[F.lit(x) for role, shown in template.labels.items() for x in (shown, role)])
    other = F.array_join(F.transform(F.split(F.substr(label, F.lit(2)), r"\\\\", -1), lambda p: _unmark(p, template)), "\\")
    return F.coalesce(F.try_element_at(named, label), other)


def _unmark(part: Column, template: Template) -> Column:
    for control, letter in template.controls.items():
        part = F.replace(part, F.lit(f"\\{letter}"), F.lit(control))
    return F.replace(part, F.lit("\\c"), F.lit(":"))


def walk(turns: Column, template: Template) -> Column:
    """struct(state, bad): bad is the 1-based place of the first turn that the machine doesn't allow, or null."""
    steps = F.create_map(*[F.lit(x) for s, to in template.machine.items() for role, t in to.items() for x in (f"{s}\n{role}", t)])

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(steps, F.concat(acc.state, F.lit("\n"), turn.role))
        n = acc.n + 1
        return F.struct(F.coalesce(to, F.lit("invalid")).alias("state"), n.alias("n"), F.coalesce(acc.bad, F.when(to.isNull(), n)).alias("bad"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, start, step)


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn) from rows (conv_id, turn, role, text)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    convs = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.mark), _label(t.role, template), F.lit(template.after))
        no = F.lit(False)
        return F.array(
            F.struct(head.alias("text"), no.alias("loss")),
            F.struct(escape(t.text, template).alias("text"), t.role.isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), no.alias("loss")),
        )

    out = convs.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), walk(F.col("turns"), template).alias("w"))
    return out.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        (F.col("w.bad").isNull() & F.col("w.state").isin(*template.final)).alias("valid"), F.col("w.bad").alias("bad_turn"),
    )


def parse(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, template.end, -1), lambda p: p != "")
    skip = len(template.mark)

    def turn(piece: Column) -> Column:
        label = F.substr(F.substring_index(piece, template.after, 1), F.lit(skip + 1))
        body = F.substr(piece, F.char_length(label) + skip + len(template.after) + 1)
        return F.struct(_role(label, template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, template)), "")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    chats = format_chats(rows.unionByName(extra))
    back = chats.select("conv_id", "formatted", "valid", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP1_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next_ FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
u AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\e') AS esc,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE
      '=' || replace(replace(replace(replace(role, '\', '\\'), '### ', '\h'), '</turn>', '\e'), ':', '\c') END AS label,
    CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
         WHEN prev = 'user' THEN role = 'assistant' ELSE false END AND (next_ IS NOT NULL OR role = 'assistant') AS ok FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(esc) + length(label) + 6 + 8)::BIGINT AS formatted_chars, bool_and(ok) AS valid
FROM u GROUP BY conv_id
"""

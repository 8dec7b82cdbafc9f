"""Chat formatting by schema fingerprints.

A record of any layout is a VARIANT. The hash of its nested field paths, types
left out, selects a declarative mapping that turns it into canonical
(role, text) turns. Turns are rendered with a template whose control strings
are escaped, reversibly, where a text holds them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let


@dataclass(frozen=True)
class Layout:
    """A mapping of one record layout.

    ``paths``: field paths as :func:`field_paths` gives them. Either ``each`` is
    the path of a list whose items have ``role`` and ``text`` fields, or
    ``turns`` lists (role, path) with a role written '$.x' read from the record.
    Turns joined by '+' are parts of one text, put together by a blank line.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)


LAYOUTS = (
    Layout("turn", ("OBJECT<role, text>",), (("$.role", "$.text"),)),
    Layout("prompt", ("OBJECT<completion, prompt>",), (("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", ("OBJECT<prompt, response>",), (("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question", ("OBJECT<answer, question>",), (("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", ("OBJECT<instruction, output>",), (("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", ("OBJECT<input, instruction, output>",), (("user", "$.instruction+$.input"), ("assistant", "$.output"))),
    Layout("system_instruction", ("OBJECT<input, instruction, output, system>",), (("system", "$.system"), ("user", "$.instruction+$.input"), ("assistant", "$.output"))),
    Layout("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<messages: ARRAY<>>"), each="$.messages", role="role", text="content"),
    Layout("conversations", ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "OBJECT<conversations: ARRAY<>>"), each="$.conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
)


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``open`` role ``sep`` text ``close``; ``reserved`` are control strings of readers to escape as well."""

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)

    def _rests(self) -> str:
        # Longest first; a control string is its first character and the rest.
        every = sorted({self.open, self.sep, self.close, *self.reserved}, key=lambda s: (-len(s), s))
        return "|".join(f"(?<={re.escape(s[0])})(?=\\\\*{re.escape(s[1:])})" for s in every)

    def escape(self, text: Column) -> Column:
        r"""Put one more backslash after the first character of each control string.

        Strings that already hold k backslashes there get k + 1, so that
        :meth:`unescape`, which takes one away, gives every text back.
        """
        return F.regexp_replace(text, self._rests(), r"\\")

    def unescape(self, text: Column) -> Column:
        every = sorted({self.open, self.sep, self.close, *self.reserved}, key=lambda s: (-len(s), s))
        return F.regexp_replace(text, "|".join(f"(?<={re.escape(s[0])})\\\\(?=\\\\*{re.escape(s[1:])})" for s in every), "")


def field_paths(record: Column) -> Column:
    """Nested field names of a VARIANT, as ``OBJECT<a, b: ARRAY<OBJECT<c>>>``; the types of leaves are left out."""
    named = F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?", "")
    return F.regexp_replace(named, r"ARRAY<(?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?>", "ARRAY<>")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Turns of a record, array<struct<role, text>>; null if no layout has its fingerprint. Null roles and texts are empty."""

    def read(path: str) -> Column:
        return F.try_variant_get(record, path, "string")

    def leaf(path: str) -> Column:
        parts = path.split("+")
        if len(parts) == 1:
            return F.coalesce(read(path), F.lit(""))
        return F.array_join(F.array(*map(read, parts)), "\n\n")

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    def mapped(layout: Layout) -> Column:
        if not layout.each:
            return F.array(*[turn(leaf(r) if r.startswith("$") else F.lit(r), leaf(p)) for r, p in layout.turns])
        items = F.try_variant_get(record, layout.each, f"array<struct<{layout.role}: string, {layout.text}: string>>")

        def item(x: Column) -> Column:
            role = x[layout.role]
            named = role
            for theirs, ours in layout.roles.items():
                named = F.when(role == theirs, ours).otherwise(named)
            return turn(F.coalesce(named, F.lit("")), F.coalesce(x[layout.text], F.lit("")))

        return F.transform(items, item)

    known = F.lit(None).cast("array<struct<role:string,text:string>>")
    mark = fingerprint(record)
    for layout in layouts:
        known = F.when(mark.isin(*[F.xxhash64(F.lit(p)) for p in layout.paths]), mapped(layout)).otherwise(known)
    return known


def format_chats(rows: DataFrame, record: str, conv: str = "conv_id", order: str = "turn", template: Template = Template(), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Render each conversation: conv, formatted, loss_spans, n_turns.

    Each row of ``rows`` has a VARIANT ``record`` of any layout; the rows of a
    conversation follow each other by ``order``, nulls first, ties by their
    turns. ``loss_spans`` are the places (start, length in code points, from 0)
    of the escaped texts of trained roles. A null ``conv`` is a conversation. Rows of no known
    layout, or with a null record, add no turns; a conversation without turns
    has an empty string. Repeated rows are repeated turns. An empty table gives
    no rows; other columns are ignored. A conversation is one string, so it
    must fit in a row; its turns are rendered before they are brought together.
    """
    turns = rows.select(F.col(conv).alias("_c"), F.col(order).alias("_o"), F.coalesce(canonical_turns(F.col(record), layouts), F.array().cast("array<struct<role:string,text:string>>")).alias("_t"))
    pieces = turns.select("_c", "_o", F.posexplode_outer("_t").alias("_i", "_x")).select(
        "_c", "_o", "_i",
        template.escape(F.col("_x.role")).alias("_role"),
        template.escape(F.col("_x.text")).alias("_text"),
        F.col("_x.role").isin(*template.trained).alias("_loss"),
    )
    head = F.concat(F.lit(template.open), F.col("_role"), F.lit(template.sep))
    pieces = pieces.select("_c", "_o", "_i", F.concat(head, F.col("_text"), F.lit(template.close)).alias("_piece"), F.when(F.col("_loss"), F.length(head)).alias("_skip"), F.length("_text").cast("long").alias("_len"))
    so_far = Window.partitionBy("_c").orderBy("_o", "_i", "_piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("_end", F.coalesce(F.sum(F.length("_piece")).over(so_far), F.lit(0)).cast("long"))
    start = F.col("_end") - F.length("_piece") + F.col("_skip")
    packed = placed.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_end", "_o", "_i", "_piece", start.cast("long").alias("start"), F.col("_len").alias("length")))).alias("_all"))
    return packed.select(
        F.col("_c").alias(conv),
        F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("formatted"),
        F.transform(F.filter("_all", lambda x: x["start"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        F.size(F.filter("_all", lambda x: x["_piece"].isNotNull())).cast("long").alias("n_turns"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted string, array<struct<role, text>>; the inverse of the template."""

    def read(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.open) + 1))
        role = F.substring_index(body, template.sep, 1)
        return F.struct(template.unescape(role).alias("role"), template.unescape(F.substr(body, F.length(role) + len(template.sep) + 1)).alias("text"))

    pieces = F.split(formatted, re.escape(template.close))
    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), read))


def read_loss(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""

    def joined(pair: Column) -> Column:
        return F.array_join(F.transform(pair["s"], lambda x: template.unescape(F.substr(pair["f"], (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")

    return let(F.struct(formatted.alias("f"), spans.alias("s")), joined)

"""Conversations rendered by a template that can be read back, in DataFrame functions alone.

The grammar of a rendered conversation is

    conversation := turn*
    turn         := opening role middle text closing

where neither role nor text holds a control string.  The parser is deterministic: it cuts at `closing`, then at the first `middle`, refuses what the
grammar does not allow, and takes one backslash out of what looks like an escaped control string.  A turn is rendered as it is, parsed, and
compared with what it came from; only if the two differ is its content escaped: a backslash more after the first letter of everything that looks like a control
string, however many it has.  Then the whole conversation is parsed and compared; if it differs still, all of its turns are
escaped, and a conversation that no escaping mends is an error, not an output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Template:
    opening: str = "[INST] "
    middle: str = " [/INST]"
    closing: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")  # what neither roles nor texts may show
    learned: tuple[str, ...] = ("assistant",)  # roles whose text is under the loss mask

    def __post_init__(self):
        heads = {c[:1] for c in self.controls}
        if any(len(c) < 2 or c[1] == "\\" or heads & set(c[1:]) for c in self.controls) or "\\" in heads:
            raise ValueError("a control string has a first letter that no control string holds further on, and no backslash next to it")
        if not any(c in self.closing for c in self.controls) or not any(c in self.middle for c in self.controls):
            raise ValueError("middle and closing hold a control string each: escaping keeps them out of texts by it")

    @property
    def lookalike(self) -> str:
        """A control string with any number of backslashes after its first letter; no two of them overlap."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return rf"([{heads}])(\\*)(" + "|".join(sorted({re.escape(c[1:]) for c in self.controls})) + ")"

    @property
    def escaped(self) -> str:
        return self.lookalike.replace(r"(\\*)", r"\\(\\*)")

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.lookalike), F.lit(r"$1\\$2$3"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.escaped), F.lit("$1$2$3"))

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.opening), role, F.lit(self.middle), text, F.lit(self.closing))

    def pieces(self, rendered: Column) -> Column:
        """The turns of a rendered conversation without their `closing`, and what is behind the last one."""
        return F.split(rendered, F.lit(re.escape(self.closing)), F.lit(-1))

    def _read(self, piece: Column) -> Column:
        """(role, text) of a turn without its `closing`, null if the grammar does not allow it."""
        at = F.instr(piece, self.middle)
        role = F.substring(piece, F.lit(len(self.opening) + 1), at - F.lit(len(self.opening) + 1))
        text = F.substring(piece, at + F.lit(len(self.middle)), F.length(piece))
        bare = [F.contains(part, F.lit(c)) for part in (role, text) for c in self.controls]
        refused = ~F.startswith(piece, F.lit(self.opening)) | (at <= F.lit(len(self.opening)))
        for test in bare:
            refused = refused | test
        return F.when(~refused, F.struct(self.unescape(role).alias("role"), self.unescape(text).alias("text")))

    def parse(self, rendered: Column) -> Column:
        """array<struct<role, text>> of a rendered conversation; a turn that the grammar does not allow, or a rest behind the last one, is null."""
        pieces = self.pieces(rendered)
        rest = F.element_at(pieces, -1)
        turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), self._read)
        return F.when(rest == F.lit(""), turns).otherwise(F.concat(turns, F.array(F.lit(None).cast("struct<role:string,text:string>"))))


def chat_format(conversations: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (what to learn: of each turn of a learned role its number `turn` from 0, `turn_start`, and
    `start` and `end` of its text, code points of `formatted`), n_escaped (turns that had to be escaped).

    Turns stand in order of `turn`, a null one first; rows with the same number by role and text; repeated rows are turns each.  Null texts
    and roles are empty.  Rows with a null conv_id are one conversation.  Other columns are ignored; an empty table gives an empty one.

    Rendering, the first parse and the running lengths are per row; one shuffle by conversation.  A conversation is one row of the
    result, so it must fit a row.
    """
    t = template
    rows = conversations.select(
        conversations[conv_id].alias("conv_id"), conversations[turn].alias("turn"),
        F.coalesce(conversations[role].cast("string"), F.lit("")).alias("role"), F.coalesce(conversations[text].cast("string"), F.lit("")).alias("text"))
    plain, safe = t.render(F.col("role"), F.col("text")), t.render(t.escape(F.col("role")), t.escape(F.col("text")))
    alike = t.parse(F.col("plain")).eqNullSafe(F.array(F.struct("role", "text")))
    tried = rows.withColumn("plain", plain).withColumn("alike", alike)
    tried = tried.withColumn("shown", F.when(F.col("alike"), F.col("plain")).otherwise(safe)).drop("plain")
    line = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = line.rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0)).cast("long")
    placed = tried.select(
        "conv_id", (F.row_number().over(line) - 1).alias("turn"), "role", "text", "shown", (~F.col("alike")).alias("escaped"),
        before(F.length("shown")).alias("turn_start"), before(F.length(safe)).alias("safe_start"))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in placed.columns if c != "conv_id"]))).alias("turns"))

    source = F.transform("turns", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    all_safe = F.array_join(F.transform("turns", lambda x: t.render(t.escape(x.role), t.escape(x.text))), "")
    first = turns.withColumn("shown", F.array_join("turns.shown", "")).withColumn("identical", t.parse(F.col("shown")).eqNullSafe(source))
    again = F.when(t.parse(all_safe).eqNullSafe(source), all_safe).otherwise(F.raise_error(F.lit("a conversation that its own rendering does not give back")))

    def span(x: Column) -> Column:
        start = F.when(F.col("identical"), x.turn_start).otherwise(x.safe_start)
        end = start + F.when(F.col("identical"), F.length(x.shown)).otherwise(F.length(t.render(t.escape(x.role), t.escape(x.text)))) - F.lit(len(t.closing))
        kept_role = F.when(x.escaped | ~F.col("identical"), t.escape(x.role)).otherwise(x.role)
        inner = start + F.length(kept_role) + F.lit(len(t.opening) + len(t.middle))
        return F.struct(x.turn.alias("turn"), start.alias("turn_start"), inner.cast("long").alias("start"), end.cast("long").alias("end"))

    spans = F.transform(F.filter("turns", lambda x: x.role.isin(*t.learned)), span)
    escaped = F.when(F.col("identical"), F.size(F.filter("turns", lambda x: x.escaped))).otherwise(F.size("turns"))
    return first.select("conv_id", F.when(F.col("identical"), F.col("shown")).otherwise(again).alias("formatted"), spans.alias("loss_spans"), escaped.alias("n_escaped"))


def masked_text(template: Template, formatted: Column, loss_spans: Column) -> Column:
    """All text under the mask, unescaped, read from the rendered conversation."""
    pieces = template.pieces(formatted)

    def read(s: Column) -> Column:
        inside = F.substring(F.get(pieces, s.turn), (s.start - s.turn_start + 1).cast("int"), (s.end - s.start).cast("int"))
        return template.unescape(inside)

    return F.array_join(F.transform(loss_spans, read), "")


def format_digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Of the rows of `chat_format`, read back from `formatted`: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars
    and loss_sha256 (the text under the mask), formatted_chars."""
    read = formatted.select("conv_id", "formatted", template.parse(F.col("formatted")).alias("turns"), masked_text(template, F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def comparison_sql(conversations: str = "conversations", probe: str = "</s>[INST] ok [/INST]") -> str:
    """The query's result in DuckDB: lengths and digests of the turns, without rendering."""
    t = Template()
    kept = lambda c: f"regexp_replace({c}, '{t.lookalike}', '\\1\\\\\\2\\3', 'g')"
    marks = len(t.opening) + len(t.middle) + len(t.closing)
    learned = " OR ".join(f"role = '{r}'" for r in t.learned)
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
    UNION ALL VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    cast(coalesce(sum(length(text)) FILTER ({learned}), 0) AS bigint) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER ({learned}), '')) AS loss_sha256,
    cast(sum({marks} + length({kept('role')}) + length({kept('text')})) AS bigint) AS formatted_chars FROM turns GROUP BY conv_id"""

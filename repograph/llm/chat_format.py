"""Chat formatting by a finite-state machine over roles and a declarative template (operator 9), in DataFrame functions only.

A template names the text before and after each role's turns and says whose text carries loss. Control strings that
stand in a text or a role are broken by an escape, reversibly: each ``\\`` is doubled, then each control string gets
``\\-`` after its first character. A single ``\\`` thus only ever stands for an escape. Control strings must begin with
``<`` or ``[``, end with ``>`` or ``]`` and hold no ``\\``, so none can arise across the seam of text and markup.

The machine starts in ``start``, and each turn's role moves it; a role for which the state has no move is a fault, and
so is an end in a state that is not final. Turns are formatted whether or not the order is valid; ``valid`` and
``first_fault`` (from 0) say so.

A conversation is one text, so its turns must meet: they are gathered with map-side combining, one row a
conversation. Defined cases: turns go by number, null first, ties by role, then text; a null text or role is empty; a
null conversation id is a conversation; repeated rows are turns of their own; an empty table gives an empty one; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that common chat tokenizers read as control tokens.
RESERVED = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")


@dataclass(frozen=True)
class Template:
    """``turn`` opens a turn, ``body`` parts role and text, ``end`` closes it; ``loss`` has the roles that are learned."""

    turn: str = "<|im_start|>"
    body: str = "<|im_body|>"
    end: str = "<|im_end|>"
    loss: tuple[str, ...] = ("assistant",)
    reserved: tuple[str, ...] = RESERVED
    start: str = "open"
    #: (state, role) to the next state.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("open", "system"): "told",
            ("open", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return list(dict.fromkeys([self.turn, self.body, self.end, *self.reserved]))

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or c[0] not in "<[" or c[-1] not in ">]" or "\\" in c:
                raise ValueError(f"not a control string: {c!r}")


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\-{c[1:]}")), template.controls, text)


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    text = reduce(lambda t, c: F.replace(t, F.lit(f"{c[0]}\\-{c[1:]}"), F.lit(c)), template.controls, text)
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def gathered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, role and text without nulls."""
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def first_fault(turns: Column, template: Template) -> Column:
    """The number of the first turn that its state has no move for, the number of turns for a bad end, or null."""
    key = lambda state, role: F.concat(state, F.lit("\n"), role)
    moves = F.create_map(*(F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)))
    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"))

    def step(acc: Column, one: Column) -> Column:
        to = F.try_element_at(moves, key(acc["state"], one["role"]))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["fault"], F.when(to.isNull(), acc["at"])).alias("fault"),
        )

    end = lambda acc: F.coalesce(acc["fault"], F.when(~acc["state"].isin(*template.final), acc["at"]))
    return F.aggregate(turns, zero, step, end)


def format_chats(
    turns: DataFrame, template: Template = DEFAULT, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row for each conversation: conv_id, segments (text, loss), formatted (the segments' texts joined), valid, first_fault."""
    lit = F.lit

    def parts(one: Column) -> Column:
        learned = one["role"].isin(*template.loss)
        segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(
            segment(F.concat(lit(template.turn), escape(one["role"], template), lit(template.body)), lit(False)),
            segment(escape(one["text"], template), learned),
            segment(lit(template.end), lit(False)),
        )

    rows = gathered(turns, conv_id, turn, role, text)
    rows = rows.select("conv_id", first_fault(F.col("turns"), template).alias("first_fault"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return rows.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("first_fault").isNull().alias("valid"),
        "first_fault",
    )


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    pieces = F.split(formatted, _literal(template.end), -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(template.turn) + 1, 2**31 - 1)
        part = F.split(inner, _literal(template.body), 2)
        return F.struct(unescape(part[0], template).alias("role"), unescape(part[1], template).alias("text"))

    return F.transform(whole, turn)


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings; all figures are read back from the output."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    out = format_chats(turns.unionByName(more))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = out.select("conv_id", read_back(F.col("formatted")).alias("turns"), learned.alias("learned"), "formatted", "valid")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The plain reading of the same figures: nothing is formatted here, so a loss in formatting shows.
OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL AS last
  FROM t
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    replace(ESC, '<|endoftext|>', '<\-|endoftext|>') AS escaped,
    CASE WHEN before IS NULL AND k = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' AND k = 2
      WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
      AND (NOT last OR role = 'assistant') AS fits
  FROM n
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY k)) AS loss_sha256,
  sum(length(escaped) + length(role) + 33)::BIGINT AS formatted_chars, bool_and(fits) AS valid
FROM e GROUP BY conv_id
""".replace("ESC", reduce(lambda t, c: f"replace({t}, '{c}', '{c[0]}\\-{c[1:]}')", [c for c in DEFAULT.controls if c != "<|endoftext|>"], r"replace(text, '\', '\\')"))

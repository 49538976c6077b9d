"""Chat formatting: conversations become segments of text with loss flags, from a declarative template.

A finite-state machine walks over the turns of a conversation.  Its states are `start` and the roles: a turn moves it to
the state of its role, and the template says in which states a role may speak and in which a conversation may end.  Each
move emits segments: the role's opening mark, the text, the closing mark.  A move that the template doesn't allow is
reported (`first_error`), not repaired, and the machine goes on from there, so a state depends on the last role alone and all
moves of a conversation are made side by side.

Texts can't forge marks: where a text holds a mark, an escape character is put behind the mark's first character; where
such characters stand there already, there is one more of them, so that taking one away gives the text back.  Each turn
is known by its closing mark, so `read_back` finds roles and texts in the formatted string alone.

Null texts are empty texts, a null role is an empty one.  Roles that the template doesn't name are written with
their name, count as errors and bear no loss.  Rows of one conversation and turn (repeated ones too) stand in order of role and
text, a null turn first.  Rows with a null conv_id make up one conversation.  An empty table gives no rows.  Only
the columns conv_id, turn, role and text are used; others, whatever they are called, don't reach the result.  A conversation
is one example for training, so it becomes one row, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Role:
    """How a role is written, and the states in which it may speak."""

    opens: str
    closes: str
    after: Sequence[str]
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """begin opens a conversation; other are the marks around the name of an unknown role and behind its text."""

    begin: str
    roles: Mapping[str, Role]
    ends: Sequence[str]
    other: tuple[str, str, str]
    escape: str = "\\"
    marks: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [m for m in (self.begin, *self.other, *(m for r in self.roles.values() for m in (r.opens, r.closes))) if m]
        first = {m[0] for m in marks}
        closes = [self.begin, *self.other, *(r.closes for r in self.roles.values())]
        if not all(closes) or len(set(closes)) < len(closes) or set(closes) & {r.opens for r in self.roles.values()}:
            raise ValueError("a turn is known by its closing mark, so each must be of its own")
        if any(first & set(m[1:]) or self.escape in m or len(m) < 2 for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("the first character of a mark mustn't stand inside marks, nor the escape character, nor may a mark begin another one")
        object.__setattr__(self, "marks", tuple(sorted(set(marks))))

    def _places(self, before: str, after: str) -> str:
        """A pattern of the places behind the first characters of marks; before and after go around that character."""
        rests: dict[str, list[str]] = {}
        for m in self.marks:
            rests.setdefault(m[0], []).append(re.escape(m[1:]))
        return "|".join(f"{before.format(re.escape(c))}{after}(?={re.escape(self.escape)}*(?:{'|'.join(r)}))" for c, r in rests.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places("(?<={})", ""), self.escape.replace("\\", "\\\\"))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places("(?<={})", re.escape(self.escape)), "")


INSTRUCT = Template(
    begin="<s>",
    roles={
        "system": Role("[SYSTEM]", "[/SYSTEM]", after=(START,)),
        "user": Role("[INST]", "[/INST]", after=(START, "system", "assistant")),
        "assistant": Role("", "</s>", after=("user",), loss=True),
    },
    ends=("assistant",),
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
)


def format_chats(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, segments, first_error, valid): segments is an array of (text, loss); its texts in order are the formatted conversation.

    first_error is the place (from 0) of the first turn that isn't allowed where it stands; valid is whether there is none and
    the last turn may be a conversation's last.
    """
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss=False: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(loss).alias("loss"))

    def emitted(turn: Column) -> Column:
        text = template.escaped(turn["text"])
        name, named, done = template.other
        out = F.array(segment(name), segment(template.escaped(turn["role"])), segment(named), segment(text), segment(done))
        for role, r in template.roles.items():
            out = F.when(turn["role"] == role, F.array(segment(r.opens), segment(text, r.loss), segment(r.closes))).otherwise(out)
        return out

    def forbidden(turn: Column, at: Column) -> Column:
        state = F.when(at == 0, F.lit(START)).otherwise(F.get(F.col("turns"), at - 1)["role"])
        allowed = F.lit(False)
        for role, r in template.roles.items():
            allowed = allowed | ((turn["role"] == role) & state.isin(*r.after))
        return F.when(~allowed, at)

    segments = F.concat(F.array(segment(template.begin)), F.flatten(F.transform("turns", emitted)))
    out = chats.select(
        "conv_id", F.filter(segments, lambda s: s["text"] != "").alias("segments"), F.array_min(F.transform("turns", forbidden)).alias("first_error"),
        F.element_at("turns", -1)["role"].isin(*template.ends).alias("_ends"),
    )
    return out.select("conv_id", "segments", "first_error", (F.col("first_error").isNull() & F.col("_ends")).alias("valid"))


def formatted(segments: Column) -> Column:
    """The conversation as one string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def trained(segments: Column, template: Template = INSTRUCT) -> Column:
    """The texts that bear loss, as they were."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))


def read_back(chats: DataFrame, text: Column, template: Template = INSTRUCT) -> DataFrame:
    """chats with turns: the array of (role, text) that the marks in the formatted text give."""
    split = chats.withColumn("_pieces", F.split(text, "(?<=" + "|".join(re.escape(m) for m in template.marks) + ")", -1))
    bare = lambda piece, mark: template.unescaped(F.left(piece, F.char_length(piece) - F.lit(len(mark))))

    def turn(piece: Column, at: Column) -> Column:
        _, named, done = template.other
        name = bare(F.get(F.col("_pieces"), at - 1), named)
        out = F.when(piece.endswith(done), F.struct(name.alias("role"), bare(piece, done).alias("text")))
        for role, r in template.roles.items():
            out = F.when(piece.endswith(r.closes), F.struct(F.lit(role).alias("role"), bare(piece, r.closes).alias("text"))).otherwise(out)
        return out

    return split.withColumn("turns", F.filter(F.transform("_pieces", turn), lambda t: t.isNotNull())).drop("_pieces")

"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags by segment.

Everything is DataFrame expressions. A conversation becomes one row, so it must fit a row (2 GB);
that is what a formatted conversation is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which order of roles is valid and which roles are learned.

    `moves` holds (state, role, next state); a conversation is valid if it ends in a state of `ends`.
    `guard` starts every control string; texts never hold it unescaped.
    """

    opens: str = "<|im_start|>"
    role_ends: str = "\n"
    closes: str = "<|im_end|>\n"
    guard: str = "<|"
    escape: str = "\\"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"),
        ("start", "user", "asked"),
        ("told", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    ends: tuple[str, ...] = ("answered",)
    learned: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escaped(text: Column, t: Template, header: bool = False) -> Column:
    """The escape sign doubles as `\\e`, the guard is split by `\\b`, in a header a line end is `\\n`.

    Every escape sign in the result starts a pair, so `unescaped` gives the text back exactly.
    """
    e = t.escape
    out = F.replace(text, F.lit(e), F.lit(f"{e}e"))
    out = F.replace(out, F.lit(t.guard), F.lit(f"{t.guard[0]}{e}b{t.guard[1:]}"))
    return F.replace(out, F.lit(t.role_ends), F.lit(f"{e}n")) if header else out


def unescaped(text: Column, t: Template, header: bool = False) -> Column:
    e = t.escape
    out = F.replace(text, F.lit(f"{e}n"), F.lit(t.role_ends)) if header else text
    out = F.replace(out, F.lit(f"{t.guard[0]}{e}b{t.guard[1:]}"), F.lit(t.guard))
    return F.replace(out, F.lit(f"{e}e"), F.lit(e))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHATML) -> DataFrame:
    """One row per conversation: `conv`, n_turns, valid, bad_turn, segments, formatted.

    segments is an array of (text, loss) that joins to `formatted`; loss is true for the texts of learned
    roles only, never for markers. bad_turn is the position (from 0) of the first turn the machine
    refuses, n_turns if only the end is missing, null if valid. Invalid conversations are formatted all
    the same. Null texts and roles count as empty; a null conversation id is a conversation; turns that
    tie go by role, then text; repeated rows are repeated turns; no rows give no rows; other columns are
    ignored.
    """
    t = template
    rows = turns.select(F.col(conv).alias("c"), F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("s"))
    chats = rows.groupBy("c").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def move(state: Column, said: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for was, by, then in t.moves:
            out = out.when((state == was) & (said == by), F.lit(then))
        return out.otherwise(F.lit("refused"))

    def step(acc: Column, x: Column) -> Column:
        to = move(acc["state"], x["r"])
        bad = F.when(acc["bad"] >= 0, acc["bad"]).when(to == "refused", acc["i"]).otherwise(F.lit(-1))
        return F.struct(to.alias("state"), (acc["i"] + 1).alias("i"), bad.alias("bad"))

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))
    ended = F.aggregate("s", begin, step)
    loss = lambda x: x["r"].isin(*t.learned)

    def piece(body: Column, flag: Column) -> Column:
        return F.struct(body.alias("text"), flag.alias("loss"))

    segments = F.flatten(
        F.transform(
            "s",
            lambda x: F.array(
                piece(F.concat(F.lit(t.opens), escaped(x["r"], t, True), F.lit(t.role_ends)), F.lit(False)),
                piece(escaped(x["x"], t), loss(x)),
                piece(F.lit(t.closes), F.lit(False)),
            ),
        )
    )
    out = chats.select("c", F.size("s").cast("long").alias("n_turns"), ended.alias("end"), segments.alias("segments"))
    valid = (F.col("end.bad") < 0) & F.col("end.state").isin(*t.ends)
    return out.select(
        F.col("c").alias(conv),
        "n_turns",
        valid.alias("valid"),
        F.when(valid, F.lit(None).cast("int")).when(F.col("end.bad") >= 0, F.col("end.bad")).otherwise(F.col("end.i")).alias("bad_turn"),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def parse_formatted(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation, as an array of (role, text): the inverse of the template."""
    t = template
    parts = F.split(formatted, f"\\Q{t.opens}\\E")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(x: Column) -> Column:
        at = F.instr(x, t.role_ends)
        body = x.substr(at + len(t.role_ends), F.length(x) - at - (len(t.role_ends) - 1) - len(t.closes))
        return F.struct(unescaped(F.substring_index(x, t.role_ends, 1), t, True).alias("role"), unescaped(body, t).alias("text"))

    return F.transform(parts, one)


def learned_text(segments: Column, template: Template = CHATML) -> Column:
    """What stands under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")

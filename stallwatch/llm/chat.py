"""Chat formatting: conversations become marked text segments with loss flags, and can be read back exactly.

A template is data: the control strings around each role's text, which roles are learned from, and the transitions of a machine
that says which role may follow. Everything runs as built-in functions. A conversation is formatted in pages, of which all but
very long ones have one, so that no task holds more than a page: the turns of long ones are numbered over all slices of the cluster,
and the machine's state at the start of a page comes from composing the transition tables of the pages before it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.llm.common import stored
from stallwatch.plans.ordered import numbered, running_totals
from stallwatch.plans.skew import lookup

ESCAPE, KEPT = "\\", "-"


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How turns are marked and which order they may have.

    ``roles`` are the known ones; any other role is written between ``other.open`` and ``name_end`` and its text after that. One blank
    parts a control string from the text. ``moves`` maps a state and a role to the next state; a turn without a move is out of order
    and leads to ``after[role]``, for other roles to ``start``.

    Texts are escaped so that no control string occurs inside: a backslash becomes backslash and minus, and a backslash goes behind
    the first character of a control string. For that to be reversible, control strings start with a character that no other
    position of them has, contain neither backslash, minus nor blank, and none begins another; else a ValueError is raised.
    """

    begin: str
    roles: Mapping[str, Role]
    other: Role
    name_end: str
    start: str
    moves: Mapping[str, Mapping[str, str]]
    after: Mapping[str, str]
    final: frozenset[str]
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "states", tuple(dict.fromkeys([self.start, *self.moves, *(s for m in self.moves.values() for s in m.values()), *self.after.values(), *self.final])))
        controls = self.controls
        heads = {c[:1] for c in controls}
        if any(len(c) < 2 or set(c[1:]) & heads or set(c) & set(ESCAPE + KEPT + " ") for c in controls):
            raise ValueError("control strings need a first character that occurs nowhere else in them, and no backslash, minus or blank")
        if any(a != b and b.startswith(a) for a in controls for b in controls) or len({r.open for r in [*self.roles.values(), self.other]}) <= len(self.roles):
            raise ValueError("no control string may begin another, and each role opens with its own")

    @property
    def controls(self) -> list[str]:
        every = [self.begin, self.name_end, *(c for r in [*self.roles.values(), self.other] for c in (r.open, r.close))]
        return sorted(set(every))

    def pattern(self) -> str:
        """The first character of any control string, seen by what follows it (the same in Java's and Python's regular expressions)."""
        by_head: dict[str, list[str]] = {}
        for c in self.controls:
            by_head.setdefault(c[0], []).append(c[1:])
        return "|".join(f"{_quoted(h)}(?=" + "|".join(_quoted(r) for r in rests) + ")" for h, rests in by_head.items())


CHAT = Template(
    begin="<s>",
    roles={"system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"), "assistant": Role("[OUT]", "</s>", loss=True)},
    other=Role("[TURN]", "[/TURN]"),
    name_end="[TEXT]",
    start="start",
    moves={"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    after={"system": "system", "user": "user", "assistant": "assistant"},
    final=frozenset({"assistant"}),
)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + KEPT)), template.pattern(), "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"\\(?!-)", ""), F.lit(ESCAPE + KEPT), F.lit(ESCAPE))


def _by_role(role: Column, template: Template, value, other: Column) -> Column:
    chain = None
    for name, r in template.roles.items():
        made = value(r)
        made = made if isinstance(made, Column) else F.lit(made)
        chain = F.when(role == name, made) if chain is None else chain.when(role == name, made)
    return other if chain is None else chain.otherwise(other)


def _segments(turns: Column, template: Template) -> Column:
    """Opening, text and closing of each turn; only a text can be learned from."""

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(turn: Column) -> Column:
        role, no = turn["role"], F.lit(False)
        named = F.concat(F.lit(template.other.open), escaped(role, template), F.lit(template.name_end + " "))
        return F.array(
            segment(_by_role(role, template, lambda r: r.open + " ", named), no),
            segment(escaped(turn["text"], template), _by_role(role, template, lambda r: r.loss, no)),
            segment(_by_role(role, template, lambda r: " " + r.close, F.lit(" " + template.other.close)), no),
        )

    return F.flatten(F.transform(turns, of))


def _symbol(role: Column, template: Template) -> Column:
    numbers = {name: i for i, name in enumerate(template.roles)}
    chain = None
    for name, i in numbers.items():
        chain = F.when(role == name, i) if chain is None else chain.when(role == name, i)
    return F.lit(len(numbers)) if chain is None else chain.otherwise(len(numbers))


def _machine(turns: Column, start: Column, template: Template) -> Column:
    """struct(state, bad): the state after all turns and the positions in the page, from 0, of turns out of order."""
    number = {s: i for i, s in enumerate(template.states)}
    to, allowed = [], []
    for state in template.states:
        for role in [*template.roles, None]:
            move = template.moves.get(state, {}).get(role)
            to.append(number[move if move is not None else template.after.get(role, template.start)])
            allowed.append(move is not None)
    width = len(template.roles) + 1
    next_state, in_order = F.array(*map(F.lit, to)), F.array(*map(F.lit, allowed))
    steps = F.transform(turns, lambda t, i: F.struct(i.alias("at"), _symbol(t["role"], template).alias("symbol")))

    def step(seen: Column, turn: Column) -> Column:
        cell = seen["state"] * width + turn["symbol"]
        bad = F.when(F.get(in_order, cell), seen["bad"]).otherwise(F.array_append(seen["bad"], turn["at"]))
        return F.struct(F.get(next_state, cell).alias("state"), bad.alias("bad"))

    return F.aggregate(steps, F.struct(start.cast("int").alias("state"), F.array().cast("array<int>").alias("bad")), step)


def _one_page(rows: DataFrame, template: Template) -> DataFrame:
    """Conversations of one page each: a single exchange on the conversation."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select("conv_id", F.lit(0).cast("long").alias("page"), F.lit(1).cast("long").alias("pages"), F.lit(True).alias("last"), _plain("turns"), F.lit(template.states.index(template.start)).alias("state"))


def _many_pages(rows: DataFrame, template: Template, page_turns: int, page_chars: int) -> DataFrame:
    """Long conversations in pages: turns numbered over slices, states at page starts composed from the pages before."""
    keys = ["key", "none"]
    keyed = rows.withColumn("key", F.xxhash64("conv_id")).withColumn("none", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    placed = stored(numbered(keyed, keys, F.col("turn"), ["role", F.md5(F.col("text").cast("binary"))], "n"), "chat-turns")
    sized = running_totals(placed, keys, F.col("n"), {"chars": F.length("text").cast("long")}, before=True)
    page = [F.floor((F.col("n") - 1) / page_turns).alias("by_turns"), F.floor(F.col("chars") / page_chars).alias("by_chars")]
    grouped = sized.groupBy("conv_id", *keys, *page).agg(F.min("n").alias("first"), F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    pages = stored(grouped.select("conv_id", *keys, (F.col("first") - 1).alias("page"), "turns"), "chat-pages")
    ends = F.array(*[_machine(F.col("turns"), F.lit(i), template)["state"] for i in range(len(template.states))])
    listed = pages.select(*keys, "page", ends.alias("ends")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "ends"))).alias("listed"))
    start = template.states.index(template.start)
    # One row of a few numbers per page; a conversation of a billion turns has a million of them.
    reached = F.aggregate(
        "listed", F.array(F.lit(start)), lambda seen, p: F.array_append(seen, F.get(p["ends"], F.element_at(seen, -1)))
    )
    states = listed.select(
        *keys, F.size("listed").cast("long").alias("pages"), F.element_at("listed", -1)["page"].alias("top"), F.explode(F.arrays_zip(F.col("listed")["page"].alias("page"), F.slice(reached, F.lit(1), F.size("listed")).alias("state"))).alias("at"),
    )
    states = states.select(*keys, "pages", F.col("at")["page"].alias("page"), F.col("at")["state"].alias("state"), (F.col("at")["page"] == F.col("top")).alias("last"))
    return lookup(pages, states, [*keys, "page"], "inner").select("conv_id", "page", "pages", "last", _plain("turns"), "state")


def format_conversations(
    df: DataFrame, template: Template = CHAT, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    page_turns: int = 4096, page_chars: int = 1 << 24,
) -> DataFrame:
    """One row per page of a conversation: conv_id, page (position of its first turn), pages, segments, out_of_order, complete.

    ``segments`` is an array of (text, loss); joined without a separator it is the formatted text. ``out_of_order`` lists the positions
    of turns the machine has no move for; such turns are formatted all the same. ``complete`` says of a last page that the machine
    stopped in a final state (null for earlier ones). Conversations above ``page_turns`` turns or ``page_chars`` characters take
    several pages, formatted and read back to the same text.

    Turns are ordered by turn (null first), then role, then the MD5 digest of the text; repeated rows count again. A null role is the
    empty one, a null text is empty. Rows with a null id make one conversation with a null id; an empty table gives no rows; other
    columns are not read.
    """
    rows = df.select(
        F.col(f"`{id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    # Only the way a conversation takes hangs on this hash, so a collision changes nothing.
    rows = rows.withColumn("route", F.xxhash64("conv_id"))
    sizes = rows.groupBy("route").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"))
    long = stored(sizes.filter((F.col("turns") > page_turns) | (F.col("chars") > page_chars)).select("route"), "chat-long")
    if long.isEmpty():
        paged = _one_page(rows, template)
    else:
        short = _one_page(lookup(rows, long, ["route"], "left_anti"), template)
        paged = short.unionByName(_many_pages(lookup(rows, long, ["route"], "left_semi").drop("route"), template, page_turns, page_chars))
    ran = paged.withColumn("ran", _machine(F.col("turns"), F.col("state"), template))
    opening = F.when(F.col("page") == 0, F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>"))
    final = [i for i, s in enumerate(template.states) if s in template.final]
    return ran.select(
        "conv_id", "page", "pages", F.concat(opening, _segments(F.col("turns"), template)).alias("segments"),
        F.transform(F.col("ran")["bad"], lambda at: F.col("page") + at).alias("out_of_order"),
        F.when(F.col("last"), F.col("ran")["state"].isin(final)).alias("complete"),
    )


def _plain(turns: str) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")


def formatted_text(segments: str | Column = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str | Column = "segments") -> Column:
    """What is learned from, as it stood in the turns."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def read_turns(formatted: Column, first_page: Column, template: Template = CHAT) -> Column:
    """The turns, array of (role, text), of one page's formatted text, from the text and the template alone.

    Text that the template cannot have made stops the job.
    """
    body = F.when(first_page, F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted))).otherwise(formatted)
    shapes = "|".join(f"{_quoted(r.open)}{'' if r is template.other else ' '}.*? {_quoted(r.close)}" for r in [*template.roles.values(), template.other])
    pieces = F.regexp_extract_all(body, F.lit(f"(?s){shapes}"), F.lit(0))

    def turn(piece: Column) -> Column:
        name = F.regexp_extract(piece, f"(?s)^{_quoted(template.other.open)}(.*?){_quoted(template.name_end)} ", 1)
        role, skip, close = unescaped(name), F.length(name) + len(template.other.open + template.name_end), F.lit(len(template.other.close))
        for known, r in template.roles.items():
            mine = piece.startswith(r.open)
            role, skip, close = F.when(mine, known).otherwise(role), F.when(mine, len(r.open)).otherwise(skip), F.when(mine, len(r.close)).otherwise(close)
        return F.struct(role.alias("role"), unescaped(F.substring(piece, skip + 2, F.length(piece) - skip - close - 2)).alias("text"))

    whole = (F.array_join(pieces, "") == body) & (~first_page | F.startswith(formatted, F.lit(template.begin)))
    return F.when(whole, F.transform(pieces, turn)).otherwise(F.raise_error(F.lit("text was not made by this template")).cast("array<struct<role:string,text:string>>"))


def digests(pages: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, from its formatted pages alone: counts, digests of turns and of what is learned from, machine's verdict.

    Columns: conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed per turn), loss_chars, loss_sha256, formatted_chars,
    n_out_of_order, complete. A digest needs its whole input in one value, so this report, unlike the pages, joins a conversation up.
    """
    read = pages.withColumn("formatted", formatted_text()).select(
        "*", read_turns(F.col("formatted"), F.col("page") == 0, template).alias("turns"), loss_text().alias("loss")
    )
    parts = read.select(
        "conv_id", "pages", "page", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.length("loss").cast("long").alias("loss_chars"), "loss", F.length("formatted").cast("long").alias("formatted_chars"), F.size("out_of_order").cast("long").alias("n_out_of_order"), "complete",
    )
    in_order = F.sort_array(F.collect_list(F.struct("page", "all", "loss")))
    several = parts.filter("pages > 1").groupBy("conv_id").agg(
        in_order.alias("listed"), *[F.sum(c).alias(c) for c in ("n_turns", "loss_chars", "formatted_chars", "n_out_of_order")], F.max("complete").alias("complete")
    )
    joined = several.select("*", *[F.array_join(F.transform("listed", lambda p: p[c]), "").alias(c) for c in ("all", "loss")])
    sha = [F.sha2(F.col(c).cast("binary"), 256).alias(name) for c, name in (("all", "turns_sha256"), ("loss", "loss_sha256"))]
    report = ["conv_id", "n_turns", sha[0], "loss_chars", sha[1], "formatted_chars", "n_out_of_order", "complete"]
    return parts.filter("pages = 1").select(*report).unionByName(joined.select(*report))


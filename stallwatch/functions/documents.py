"""Values at given paths of a JSON text replaced in place, as column expressions; all other characters stay as they are.

The text is cut into strings, marks and what lies between, and one fold over these pieces follows the path. What it collects is
only where the wanted values stand, so numbers keep their spelling, keys their order, and repeated keys are all found.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = r'"[^"]*"|[{}\[\]:,]|[^"{}\[\]:,]+|"'
STATE = ("at", "path", "key", "wants_key", "open_at", "open_path", "open_kind", "found")


def _text_of(token: Column) -> Column:
    """The content of a JSON string."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.instr(token, "\\") > 0, F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 0)).otherwise(plain)


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def replace_at_paths(text: Column, paths: Mapping[tuple[str, ...], str], replacement: Callable[[str, Column], Column]) -> Column:
    """``text`` with the value at every path of ``paths`` replaced by ``replacement(kind, value)``, a text, where that is not null.

    A path leads through objects only, never through arrays. ``value`` is the content of a string, and else the JSON text of a number, a
    word, an object or an array. Values null, false, 0 and the empty string stay. Text that is not an object stays as it is; in
    damaged text the values before the damage are still replaced. Without a hit the very text comes back.
    """
    # A path as text: a step into an object is "/:key", into an array "/[". Keys have their slashes taken out, so steps stay apart.
    kinds = F.create_map(*[F.lit(v) for path, kind in paths.items() for v in ("/:" + "".join(f"/:{step}" for step in path), kind)])
    # Escaped characters cannot end a string: they are masked, one for one, for cutting only.
    masked = F.regexp_replace(text, r"(?s)\\.", "__")
    pieces = F.regexp_extract_all(masked, F.lit(PIECES), F.lit(0))

    def step(s: Column, piece: Column) -> Column:
        first, size = F.substring(piece, 1, 1), F.length(piece)
        own = F.substring(text, s["at"], size)
        here = F.concat(s["path"], F.lit("/:"), F.coalesce(s["key"], F.lit("\u0001")))
        kind = F.try_element_at(kinds, here)
        free = kind.isNotNull() & s["open_at"].isNull() & ~s["wants_key"]
        upper = F.substring(s["path"], F.lit(1), F.length(s["path"]) - F.length(F.substring_index(s["path"], "/", -1)) - 1)

        def now(**changed: Column) -> Column:
            values = {name: s[name] for name in STATE} | {"at": s["at"] + size} | changed
            return F.struct(*[values[name].alias(name) for name in STATE])

        def hit(start: Column, length: Column, kind: Column) -> Column:
            return F.array_append(s["found"], F.struct(start.alias("start"), length.alias("length"), kind.alias("kind")))

        nothing, no = F.lit(None).cast("string"), F.lit(False)
        word, lead = strip_blanks(own), F.length(own) - F.length(F.regexp_replace(own, r"^\s+", ""))
        bare = now(found=F.when(free & ~word.isin("", "null", "false", "0", "0.0"), hit(s["at"] + lead, F.length(word), kind)).otherwise(s["found"]))
        string = F.when(s["wants_key"], now(key=F.replace(_text_of(own), F.lit("/"), F.lit("\u0001")))).otherwise(now(found=F.when(free & (size > 2), hit(s["at"], size, kind)).otherwise(s["found"]), key=nothing))

        def opened(mark: str, wants: bool) -> Column:
            return now(
                path=F.concat(s["path"], F.lit("/[")) if mark == "[" else F.when(s["path"] == "", "/:").otherwise(here),
                key=nothing, wants_key=F.lit(wants), open_at=F.when(free, s["at"]).otherwise(s["open_at"]), open_path=F.when(free, s["path"]).otherwise(s["open_path"]),
                open_kind=F.when(free, kind).otherwise(s["open_kind"]),
            )

        ends = s["open_at"].isNotNull() & (upper == s["open_path"])
        closed = now(
            path=upper, key=nothing, wants_key=no, open_at=F.when(~ends, s["open_at"]), open_path=F.when(~ends, s["open_path"]), open_kind=F.when(~ends, s["open_kind"]),
            found=F.when(ends, hit(s["open_at"], s["at"] + 1 - s["open_at"], s["open_kind"])).otherwise(s["found"]),
        )
        comma = now(wants_key=F.startswith(F.substring_index(s["path"], "/", -1), F.lit(":")), key=nothing)
        return (
            F.when(first == '"', string).when(first == "{", opened("{", True)).when(first == "[", opened("[", False))
            .when(first.isin("}", "]"), closed).when(first == ":", now(wants_key=no)).when(first == ",", comma).otherwise(bare)
        )

    span = "array<struct<start:int,length:int,kind:string>>"
    start = F.struct(
        F.lit(1).alias("at"), F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("wants_key"),
        F.lit(None).cast("int").alias("open_at"), F.lit(None).cast("string").alias("open_path"), F.lit(None).cast("string").alias("open_kind"), F.array().cast(span).alias("found"),
    )
    found = F.aggregate(pieces, start, step, lambda s: s["found"])

    def new_text(hit: Column) -> Column:
        own = F.substring(text, hit["start"], hit["length"])
        value = F.when(F.startswith(own, F.lit('"')), _text_of(own)).otherwise(own)
        chain = None
        for kind in dict.fromkeys(paths.values()):
            made = replacement(kind, value)
            chain = F.when(hit["kind"] == kind, made) if chain is None else chain.when(hit["kind"] == kind, made)
        return F.coalesce(F.concat(F.lit('"'), chain, F.lit('"')), own)

    def rewritten(hits: Column) -> Column:
        def part(hit: Column, i: Column) -> Column:
            last = F.get(hits, i - 1)
            begin = F.when(i == 0, 1).otherwise(last["start"] + last["length"])
            return F.concat(F.substring(text, begin, hit["start"] - begin), new_text(hit))

        end = F.element_at(hits, -1)
        return F.concat(F.array_join(F.transform(hits, part), ""), F.substring(text, end["start"] + end["length"], F.length(text)))

    # The hits are worked out once, as the value a one-element fold passes on.
    return F.element_at(F.transform(F.array(found), lambda hits: F.when(F.size(hits) == 0, text).otherwise(rewritten(hits))), 1)

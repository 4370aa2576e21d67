"""Quality rules: text statistics as column expressions, and decision lists learned from labelled statistics.

Everything here is DataFrame code: statistics are built-in functions, learning counts labelled rows per threshold with
one aggregation a step, and a learned list is an ordered ``when`` chain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.llm.common import held_out, spare, stored

BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[ \t\n\x0B\f\r]+"
WINDOW = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "stop_share", "line_words", "longest_word")


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def text_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (longs) and the learned list's features (doubles), each computed from the whole text.

    n_words; word_chars, code points in words; n_symbols, characters of ``#*$%&|<>``; n_dup_lines, lines with a word equal to an
    earlier line; n_repeat_words, words inside 8-word windows that occur twice or more (windows are compared by a 64-bit
    hash within one text). A null or empty text has zeros throughout. Names that a column already has get underscores in
    front; ``statistic_names`` tells them.
    """
    name = statistic_names(docs.columns)
    t, ws, os, hs, ss = (spare(n, [*docs.columns, *name.values()]) for n in ("t__", "words__", "ones__", "hashes__", "sorted__"))
    ones = F.col(os)
    given = [F.col(f"`{c}`") for c in docs.columns]
    body = docs.select(*given, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    cut = body.select("*", words_of(F.col(t)).alias(ws))
    words, n = F.col(ws), F.size(ws)
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(ones, i + k) for k in range(WINDOW)]))
    hashed = cut.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias(os)).select("*", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias(hs))
    # only texts in which some window repeats are sorted
    some = F.size(F.array_distinct(hs)) < F.size(hs)
    pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.select("*", F.when(some, pairs).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")).alias(ss))
    s = F.col(ss)
    twice = F.filter(ss, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
    starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    covered = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    letters = F.length(F.array_join(words, "")).cast("long")

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "")).cast("long")

    out = ordered.select(
        *given,
        n.cast("long").alias(name["n_words"]), letters.alias(name["word_chars"]), left(r"[^#*$%&|<>]+").alias(name["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(name["n_dup_lines"]), covered.alias(name["n_repeat_words"]),
        left(r"[^\p{Lu}]+").alias(f"{t}upper"), F.size(F.array_distinct(words)).alias(f"{t}distinct"), F.size(lines).alias(f"{t}lines"),
        F.size(F.filter(words, lambda w: F.length(w) <= 3)).alias(f"{t}short"), F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).alias(f"{t}longest"),
    )

    def share(top: str, below: Column) -> Column:
        return F.coalesce(F.col(top) / F.nullif(below, F.lit(0)), F.lit(0.0))

    total = F.col(name["n_words"])
    made = {
        "word_length": share(name["word_chars"], total), "symbol_share": share(name["n_symbols"], total), "dup_line_share": share(name["n_dup_lines"], F.col(f"{t}lines")),
        "repeat_share": share(name["n_repeat_words"], total), "upper_share": share(f"{t}upper", F.col(name["word_chars"])), "distinct_share": share(f"{t}distinct", total),
        "stop_share": share(f"{t}short", total), "line_words": share(name["n_words"], F.col(f"{t}lines")), "longest_word": F.col(f"{t}longest").cast("double"),
    }
    # a generated row: filters on statistics stay above it, where Spark would otherwise compute the statistics anew for every use
    return out.select(*given, F.inline(F.array(F.struct(*[F.col(name[c]) for c in BASE], *[v.alias(name[k]) for k, v in made.items()]))))


def statistic_names(columns: list[str]) -> dict[str, str]:
    return {n: spare(n, columns) for n in dict.fromkeys((*BASE, *FEATURES))}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bound: float

    def column(self, name: dict[str, str]) -> Column:
        value = F.col(f"`{name[self.feature]}`").cast("double")
        return value >= self.bound if self.at_least else value < self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.bound:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction; a text that meets one is rejected, the others are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejected_by(self, name: dict[str, str]) -> Column:
        """The number of the first rule a row meets, from 1; null if it meets none."""
        chain = F
        for k, rule in enumerate(self.rules, start=1):
            chain = chain.when(_all(rule, name), F.lit(k))
        return chain if self.rules else F.lit(None).cast("int")

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(map(str, rule)) for k, rule in enumerate(self.rules, start=1)) or "keep all"


def _all(rule: tuple[Condition, ...], name: dict[str, str]) -> Column:
    met = F.lit(True)
    for condition in rule:
        met = met & condition.column(name)
    return met


def learn_decision_list(
    labelled: DataFrame, bad: str = "bad", prune: str = "prune", *, features: tuple[str, ...] = FEATURES, cuts: int = 24, most_rules: int = 8,
    most_conditions: int = 4, least_rows: int = 5, precision: float = 0.9,
) -> DecisionList:
    """Sequential covering: grow a conjunction by information gain, prune it on held-back rows, take its rows out, go on.

    ``labelled`` has the features, ``bad`` (1: to be rejected, 0: to be kept) and ``prune`` (true: held back for pruning). Bounds are
    quantiles of both classes. Each step counts rows per (feature, interval), so what reaches the driver is bounded by features
    times cuts. A rule is accepted if it rejects at least ``least_rows`` rows of all, and ``precision`` of them, on either part, are bad;
    the rows of a refused one are set aside, and the covering goes on without them. No rows, or rows of one class, give an empty list.
    """
    names = {f: f for f in features}
    bounds: dict[str, list[float]] = {f: [] for f in features}
    for kind in (0, 1):
        part = labelled.filter(F.col(bad) == kind)
        for f, found in zip(features, part.approxQuantile(list(features), [i / cuts for i in range(cuts + 1)], 0.002)):
            bounds[f] += found
    bounds = {f: sorted({b for b in found if b is not None and math.isfinite(b)}) for f, found in bounds.items()}
    # the number of bounds at or below a value says which conditions on that feature it meets
    places = [_place(F.col(f).cast("double"), bounds[f]) for f in features]
    cells = stored(labelled.select(*features, F.col(bad).cast("int").alias("bad"), F.col(prune).alias("prune"), F.array(*places).alias("places")), "rule-cells")

    def counts(rows: DataFrame) -> tuple[int, int]:
        found = rows.agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).first()
        return int(found["p"] or 0), int(found["n"] or 0)

    rules: list[tuple[Condition, ...]] = []
    refused: list[tuple[Condition, ...]] = []
    while len(rules) < most_rules and len(refused) < most_rules:
        rest = cells.filter(~F.coalesce(DecisionList((*rules, *refused)).rejected_by(names) > 0, F.lit(False)))
        grow = rest.filter(~F.col("prune"))
        rule: tuple[Condition, ...] = ()
        p0, n0 = counts(grow)
        while p0 and n0 and len(rule) < most_conditions:
            table = grow.filter(_all(rule, names)).select("bad", F.posexplode("places").alias("f", "place")).groupBy("f", "place").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("m"))
            best, gain = None, 0.0
            cells_of: dict[int, list] = {}
            for row in table.collect():
                cells_of.setdefault(row["f"], []).append((row["place"], row["p"], row["m"] - row["p"]))
            for f, found in sorted(cells_of.items()):
                for k, bound in enumerate(bounds[features[f]], start=1):
                    above = [(p, n) for place, p, n in found if place >= k]
                    for at_least in (True, False):
                        p = sum(a for a, _ in above) if at_least else p0 - sum(a for a, _ in above)
                        n = sum(b for _, b in above) if at_least else n0 - sum(b for _, b in above)
                        if p < least_rows:
                            continue
                        now = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if now > gain + 1e-9:
                            best, gain, after = Condition(features[f], at_least, bound), now, (p, n)
            if best is None:
                break
            rule, (p0, n0) = (*rule, best), after
        if not rule:
            break
        # the shortest prefix that is best on the rows held back
        held = rest.filter("prune").agg(*[F.sum(F.when(_all(rule[:k], names), v)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((held[f"p{k}"] or 0) - (held[f"n{k}"] or 0)) / max(1, (held[f"p{k}"] or 0) + (held[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        rule = rule[: worth.index(max(worth)) + 1]
        ok = True
        total = 0
        for part in (grow, rest.filter("prune")):
            p, n = counts(part.filter(_all(rule, names)))
            ok, total = ok and p >= precision * (p + n), total + p
        (rules if ok and total >= least_rows else refused).append(rule)
    return DecisionList(tuple(rules))


def _place(value: Column, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value)) if bounds else F.lit(0)


def fit_rules(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", most_labels: int = 20_000,
    least_words: int = 20, most_repeats: int = 30, **settings,
) -> DecisionList:
    """A decision list from documents whose ``label`` is 0 (bad) or 1 (good), held-out ones aside.

    At most ``most_labels`` labelled rows are used, those with the smallest hash of their id. That bound is also the size bound of
    the ids sent to all tasks, so only labelled texts get their statistics here; of rows that share an id one text (the smallest) is
    learned from. Documents that fail the base rules (see :func:`judge`) need no learned one and are left out, like null ids and labels.
    """
    known = labels.select(F.col(f"`{id}`").cast("long").alias("label_id"), F.col(f"`{label}`").alias("good")).filter("label_id IS NOT NULL AND good IN (0, 1)").filter(~held_out("label_id"))
    chosen = stored(known.groupBy("label_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("label_id"), "label_id").limit(most_labels), "rule-labels")
    named = docs.select(F.col(f"`{id}`").cast("long").alias("label_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")).join(F.broadcast(chosen), "label_id")
    texts = named.groupBy("label_id").agg(F.min("good").alias("good"), F.min("body").alias("body"))
    rows = text_statistics(texts, text="body").filter(~_fails(F.col("n_words"), F.col("n_repeat_words"), least_words, most_repeats))
    rows = rows.withColumns({"bad": 1 - F.col("good"), "prune": F.pmod(F.xxhash64(F.lit("prune"), "label_id"), F.lit(3)) == 0})
    return learn_decision_list(stored(rows.select(*FEATURES, "bad", "prune"), "rule-rows"), **settings)


def _fails(words: Column, repeats: Column, least_words: int, most_repeats: int) -> Column:
    return (words < least_words) | (100 * repeats > most_repeats * words)


def judge(docs: DataFrame, rules: DecisionList, *, text: str = "text", least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """``docs`` with its statistics, base_failed, kept and rule (which learned rule rejected it), in one pass without a shuffle.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeats`` per cent of them in repeated windows. kept is false
    if base_failed, otherwise if a learned rule is met. Null and empty texts fail for want of words. Repeated rows are
    judged alike, an empty table stays empty, and new names get underscores in front where a column has them.
    """
    name = statistic_names(docs.columns)
    failed, kept, rule = (spare(n, docs.columns) for n in ("base_failed", "kept", "rule"))
    rows = text_statistics(docs, text=text)
    words, repeats = F.col(f"`{name['n_words']}`"), F.col(f"`{name['n_repeat_words']}`")
    found = rows.withColumns({failed: _fails(words, repeats, least_words, most_repeats), rule: rules.rejected_by(name)})
    return found.withColumn(kept, ~F.col(f"`{failed}`") & F.col(f"`{rule}`").isNull())


def keep_good(docs: DataFrame, rules: DecisionList, *, text: str = "text", least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """The documents that :func:`judge` keeps, with their own columns only."""
    judged = judge(docs, rules, text=text, least_words=least_words, most_repeats=most_repeats)
    return judged.filter(F.col(f"`{spare('kept', docs.columns)}`")).select(*[F.col(f"`{c}`") for c in docs.columns])

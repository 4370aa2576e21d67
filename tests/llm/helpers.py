"""Rows that every operator has to take: nulls, empties, blanks, ties, repeats, and columns with clashing names."""

from __future__ import annotations

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing near the old river bank today".split()


def sentence(seed: int, n: int) -> str:
    """``n`` words that depend on ``seed`` and hardly repeat."""
    out, x = [], seed * 2654435761 + 1
    for i in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"{WORDS[(x >> 33) % len(WORDS)]}{(x >> 40) % 97}")
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with every kind of oddity."""
    line = "This very line is longer than forty characters and is shared."
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n\x0b\x0c\r \n\n", "en", None, 9), (4, "one", "en", "a", 3),
        (5, sentence(5, 40), "en", "a", None), (5, sentence(5, 40), "en", "a", None), (None, f"{line}\n{sentence(9, 30)}", "en", "a", 1),
        (6, "ÀÉ ß naïve İstanbul\n" + "x" * 50 + "\n" + "X" * 50, "fr", "b", 5), (7, "word " * 500, "en", "b", 2500), (8, sentence(8, 6000), "de", "hot", 9),
        (-3, "negative id\n" + line, "en", "hot", 4), (1 << 62, "a large id\n" + line, "en", "hot", 4),
    ]
    return rows + [(20 + i, f"{sentence(100 + i, 25)}\n  {line.upper()}\t\n{sentence(200 + i, 25)}", "en", "hot", 7) for i in range(6)]


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names the operators use inside, in other cases and types
CLASHING = "score string, removed int, N_LINES int, n_dropped string, kept string, rule string, base_failed int, n_words string, shard int, page int, bytes string, body int, cut int, component_id string, item_id string"


def odd_docs(spark, clash: bool = False):
    df = spark.createDataFrame(odd_rows(), DOCS)
    if not clash:
        return df
    names = [c.split()[0] for c in CLASHING.split(", ")]
    more = spark.createDataFrame([tuple(None if i % 2 else (str(i) if " string" in c else i) for i, c in enumerate(CLASHING.split(", ")))], CLASHING)
    return df.crossJoin(more.select(*names))


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)

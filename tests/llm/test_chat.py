"""Chat formatting against a plain version, its round trip under hostile texts, pages, and the order machine."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stallwatch.llm import chat, queries
from stallwatch.llm.chat import CHAT, Role, Template

ROWS = "conv_id bigint, turn bigint, role string, text string"
PARTS = [*CHAT.controls, "\\", "\\-", "-", "[", "<", "]", ">", "s>", "INST]", "[\\INST]", "<\\s>", " ", "\n", "é", "😀", "a", "/", "[[INST]]", "<s", "$0", "\x00"]


def escape(text):
    out = text.replace("\\", "\\-")
    for c in CHAT.controls:
        out = out.replace(c, c[0] + "\\" + c[1:])
    return out


def plain(rows):
    """Per conversation: turns, loss text, formatted text, positions out of order, complete."""
    by, out = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), hashlib.md5((text or "").encode()).hexdigest(), role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        text, state, bad, learned = CHAT.begin, "start", [], []
        for i, (*_, role, said) in enumerate(turns):
            r = CHAT.roles.get(role)
            text += (r.open if r else CHAT.other.open + escape(role) + CHAT.name_end) + " " + escape(said) + " " + (r or CHAT.other).close
            if role not in CHAT.moves[state]:
                bad.append(i)
            state = role if r else "start"
            learned += [said] if role == "assistant" else []
        out[conv] = ([(t[-2], t[-1]) for t in turns], "".join(learned), text, bad, state == "assistant")
    return out


def report(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        conv: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text), len(bad), done)
        for conv, (turns, learned, text, bad, done) in plain(rows).items()
    }


def odd_rows():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None, "[/TURN]\\", "[TEXT] x"]), "".join(rng.choices(PARTS, k=rng.randrange(12))) if rng.random() > 0.1 else None) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "no id"), (None, 0, "system", None), (99, None, "user", "b"), (99, None, "user", "a"), (99, None, None, None), (98, 0, "user", "same"), (98, 0, "user", "same"), (97, 0, "user", "long " * 20000)]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t} [INST]") for t in range(100, 400)]
    return rows


@pytest.mark.parametrize("page", [4096, 7])
def test_formatting_and_reading_back(spark, page):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS).withColumn("segments", F.lit(1)).withColumn("KEY", F.lit("x")).repartition(5)
    pages = chat.format_conversations(df, page_turns=page).cache()
    assert {r[0]: tuple(r[1:]) for r in chat.digests(pages).collect()} == report(rows)
    want, texts, bad = plain(rows), {}, {}
    for r in sorted(pages.select("conv_id", "page", chat.formatted_text().alias("text"), "out_of_order").collect(), key=lambda r: r.page):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
        bad[r.conv_id] = bad.get(r.conv_id, []) + list(r.out_of_order)
    assert texts == {c: w[2] for c, w in want.items()} and bad == {c: w[3] for c, w in want.items()}
    assert (pages.filter("pages > 1").count() > 40) == (page == 7)
    pages.unpersist()


def test_no_control_string_stays_in_a_text(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(15))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t"), CHAT).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("back")).collect():
        assert r.back == r.t and r.e == escape(r.t) and not any(c in r.e for c in CHAT.controls)


def test_pages_by_characters_and_foreign_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * 300) for t in range(20)] + [(2, 0, "user", "hi")]
    pages = chat.format_conversations(spark.createDataFrame(rows, ROWS), page_chars=1000)
    assert {r[0]: tuple(r[1:]) for r in chat.digests(pages).collect()} == report(rows)
    assert pages.filter("conv_id = 1").count() >= 6 and pages.filter("conv_id = 2").count() == 1
    made = spark.createDataFrame([("<s>[INST] a [/INST] b",)], "t string")
    with pytest.raises(Exception, match="not made by this template"):
        made.select(chat.read_turns(F.col("t"), F.lit(True))).collect()


def test_templates_that_cannot_be_read_back_are_refused():
    for roles in ({"a": Role("[A]", "[A]x")}, {"a": Role("[ A]", "[/A]")}, {"a": Role("[A[", "]")}, {"a": Role("<-", "[/A]")}, {"a": Role("[TURN]", "[/A]")}):
        with pytest.raises(ValueError):
            Template("<s>", roles, Role("[TURN]", "[/TURN]"), "[TEXT]", "start", {}, {}, frozenset())


def test_empty_table_and_query(spark, folder):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], ROWS))).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["op11_chat_formatting"](spark, folder).collect()} == report(rows)

"""Chat formatting: round trips of conversations that try to break the template, and digests against SQL."""

import hashlib
import random

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from starloom.llm import chat

PARTS = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "\\\\", " ", "\n", "a", "é🎉", "<<SYS>>", "<</SYS>>", "[", "<", "/", "[ROLE]", "[TEXT]", "[/ROLE]", " [/INST]\n", " </s>\n[INST] "]


def made(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(n)))


def test_any_turns_come_back_from_the_whole_text():
    rng = random.Random(7)
    turns = [(rng.choice(["user", "assistant", "system", "", made(rng, 4)]), made(rng, 9)) for _ in range(20_000)]
    whole = "".join(chat.formatted(role, text)[0] for role, text in turns)
    assert [(role, chat.unescaped(whole[a:b])) for role, a, b in chat.parsed(whole)] == turns


def test_escapes_only_where_the_parser_would_be_misled():
    assert chat.formatted("user", "a [b] <c> \\ d")[0] == "[INST] a [b] <c> \\ d [/INST]\n"
    assert chat.formatted("assistant", "x </s>\n")[0] == "<s> x \\</s>\n </s>\n"
    assert chat.formatted("user", "\\[INST]")[0] == "[INST] \\\\[INST] [/INST]\n"


@pytest.mark.parametrize("broken", ["[INST] a", "a", "[INST] a </s>\n", "<s>\n</s>\n", "[ROLE] a [/ROLE]\n", "[INST] a [/INST]\nb", "<s> a</s>\n"])
def test_other_strings_are_not_of_the_grammar(broken):
    assert chat.parsed(broken) is None


def test_query_gives_what_sql_gives(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    answer = con.execute(chat.SQL)
    names = [d[0] for d in answer.description]
    assert sorted(map(repr, answer.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in chat.op11_chat(spark, SF).collect())


def test_odd_rows(spark):
    rows = [(1, 2, None, "x"), (1, 1, "user", None), (1, 1, "user", None), (None, 0, "assistant", "</s>"), (2, None, "assistant", "b"), (2, 0, "assistant", ""), (3, 0, "assistant", "word " * 4_000_000)]
    turns = spark.createDataFrame([(*r, "y", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, loss int")
    got = {r.conv_id: r for r in chat.digests(chat.recovered(chat.rendered(turns))).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, digest("user\n\nuser\n\n\nx\n"), 0, digest(""))
    assert (got[None].loss_chars, got[None].loss_sha256) == (4, digest("</s>"))
    assert (got[2].n_turns, got[2].loss_sha256) == (2, digest("b"))
    assert got[3].loss_chars == 20_000_000 and got[3].loss_sha256 == digest("word " * 4_000_000)
    assert chat.digests(chat.recovered(chat.rendered(turns.where("false")))).count() == 0


def test_mask_covers_assistant_texts_only(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<s>a")], "conv_id bigint, turn bigint, role string, text string")
    user, answer = chat.rendered(turns).orderBy("turn").select("*", F.expr("substring(formatted, mask_start + 1, mask_end - mask_start)").alias("learned")).collect()
    assert user.mask_start is None and answer.learned == "\\<s>a"

import random
import unicodedata

import pytest

from rollmill.llm import leakage

CHATS = "chat_id long, data_source string, messages array<struct<role:string,content:string>>, item_id int, key string"
ITEMS = "item_id long, extra_info struct<question:string,answer:string>, chat_id int, part string, text string"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "va") for b in ("ben", "dor", "fil", "gat", "hux")]


def text(n, seed):
    random.seed(seed)
    return " ".join(random.choice(WORDS) + str(random.randrange(99)) for _ in range(n))


def items(spark, rows):
    return spark.createDataFrame([(i, None if q is None and a is None else (q, a), 1, "p", "t") for i, q, a in rows], ITEMS)


def chats(spark, rows):
    return spark.createDataFrame([(i, s, m, 1, "k") for i, s, m in rows], CHATS)


def words(t):
    return leakage.normal_form(t).split()


def brute(chat_rows, item_rows, n=10):
    out = set()
    for chat, _, messages in chat_rows:
        for item, *texts in item_rows:
            for t in texts:
                w = words(t or "")
                windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                for m in messages or []:
                    v = words((m[1] if m else None) or "")
                    if any(tuple(v[i : i + n]) in windows for i in range(len(v) - n + 1)):
                        out.add((chat, item))
    return out


def test_normal_form():
    assert leakage.normal_form("Ａ­b​c, D_e-ﬁ 5²!") == unicodedata.normalize("NFKC", "abc d e fi 52")
    assert leakage.normal_form("Don't  STOP_now; 3.5") == "don t stop now 3 5"


@pytest.mark.parametrize("seed", range(8))
def test_found_as_by_brute_force(spark, seed):
    random.seed(seed)
    sources = [(i, text(random.randint(8, 40), 100 * seed + i), text(random.randint(5, 30), 500 + 100 * seed + i)) for i in range(12)]
    rows = []
    for k in range(60):
        w = random.choice(sources)[random.choice((1, 2))].split()
        n, at = random.choice((8, 9, 10, 11, 20)), random.randrange(max(1, len(w) - 8))
        passage = w[at : at + n]
        if random.random() < 0.3 and passage:
            passage[random.randrange(len(passage))] = "altered"
        sep = random.choice((" ", "\n", ", ", " — "))
        rows.append((k, "s", [("user", text(5, 900 + k)), ("assistant", f"{text(6, 2000 + k)} {sep.join(passage).upper()}. {text(4, 3000 + k)}")]))
    got = {tuple(r) for r in leakage.leaks(chats(spark, rows), items(spark, sources)).collect()}
    assert got == brute(rows, sources)


def test_edges(spark):
    question = text(14, 1)
    sources = [(1, question, None), (2, question, "short one"), (3, None, None), (3, "", ""), (None, question, question)]
    long = (text(30_000, 2) + " " + question + " " + text(30_000, 3)).replace(" ", "  ")
    rows = [(1, None, [("user", question)]), (1, None, [("user", question)]), (2, "s", None), (3, "s", []), (4, "s", [("user", None), ("user", "")]), (5, "s", [("user", question[:40])]), (6, "s", [("user", " ".join(question.split()[:7])), ("user", " ".join(question.split()[7:]))]), (7, "t", [("user", long)]), (None, "s", [("user", question)])]
    assert {tuple(r) for r in leakage.leaks(chats(spark, rows), items(spark, sources)).collect()} == {(1, 1), (1, 2), (7, 1), (7, 2)}
    by = {r.data_source: (r.n_docs, r.n_leaked_docs, r.n_leaked_items) for r in leakage.leaks_by_source(chats(spark, rows), items(spark, sources)).collect()}
    assert by == {None: (1, 1, 2), "s": (5, 0, 0), "t": (1, 1, 2)}


def test_passage_with_an_edit_is_reported(spark):
    question = text(16, 8)
    edited = question[:60] + "x" + question[60:]
    found = leakage.leaked_passages(chats(spark, [(1, "s", [("user", edited)])]), items(spark, [(1, question, None)])).collect()
    assert found and all(r.edits <= 8 for r in found)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_TEXTS", 3)
    sources = [(i, text(15, 40 + i), text(15, 80 + i)) for i in range(6)]
    rows = [(i, "s", [("user", q)]) for i, q, _ in sources]
    assert {tuple(r) for r in leakage.leaks(chats(spark, rows), items(spark, sources)).collect()} == {(i, i) for i in range(6)}


def test_empty_tables(spark):
    assert leakage.leaks(chats(spark, []), items(spark, [(1, text(12, 1), None)])).count() == 0
    assert leakage.leaks(chats(spark, [(1, "s", [("user", text(12, 1))])]), items(spark, [])).count() == 0

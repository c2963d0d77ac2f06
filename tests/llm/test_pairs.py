import pytest

from rollmill.llm import answers, pairs, shape

Q = "At the market, Anna and Ben share 26 marbles between the box and the bag. How many marbles does Anna keep once the bag holds 12 of them?"
FINE = "The bag holds 12 of the marbles, so 14 are left in the box. Each of the two then counts the rest of them again. The result is $\\boxed{14}$"


@pytest.mark.parametrize(
    "text, state",
    [
        (None, shape.BLANK), ("", shape.BLANK), (" \n​\xa0 ", shape.BLANK),
        ("All is done.", shape.FINISHED), ("Is it?", shape.FINISHED), ("完成了。", shape.FINISHED), ("so it holds ∎", shape.FINISHED), ('He said: "yes."', shape.FINISHED),
        ("x\n#### 92", shape.FINISHED), ("Answer: 513", shape.FINISHED), ("we get $\\boxed{\\frac{1}{2}}$", shape.FINISHED), ("<answer>3</answer>", shape.FINISHED), ("```python\nreturn x\n```", shape.FINISHED),
        ("Then the sum is the", shape.UNENDED), ("leaves 27", shape.UNENDED), ("a list,", shape.UNENDED),
        ("```python\nreturn x.", shape.CUT), ("we get $\\frac{1}{2", shape.CUT), ("so $x^2 + 1.", shape.CUT), ("<think>first.", shape.CUT), ("and then we mo…", shape.CUT), ("half a sign �", shape.CUT), ("an escape \\u00", shape.CUT),
        ("Costs {a} and $5 {b.", shape.CUT), ("a } b { c.", shape.FINISHED), ("<br>fine.", shape.FINISHED), ("<think>a</think> b.", shape.FINISHED), ("x" * 200_000 + ".", shape.FINISHED),
    ],
)
def test_states(text, state):
    assert shape.state_of(text) == state


@pytest.mark.parametrize("text", [None, "", " ", "​", "null", "N/A", "n/a", "-", "...", "[]", "####", "(no answer)", "<think>\n\n</think>\n", "<answer></answer>", "\\boxed{}", "None", "Answer:", "```\n```"])
def test_empty(text):
    assert answers.is_empty(text)


@pytest.mark.parametrize("text", ["0", "No.", "yes", FINE, "$x$", "无解"])
def test_not_empty(text):
    assert not answers.is_empty(text)


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I can't help with that request.", "I must decline: I do not have permission to discuss the catalogue at this time.", "As a language model, I won't provide a solution here. Please ask someone qualified instead.",
        "Unfortunately, answering this would go against my guidelines.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Toutes mes excuses, je ne peux pas aider avec cette demande.", "Por desgracia, no me está permitido hablar de ello. ¿Puedo ayudarte con otro tema?", "对不起，我必须拒绝这个要求。",
    ],
)
def test_refusals(text):
    assert answers.is_refusal(text)


@pytest.mark.parametrize("text", ["I can't shorten this any further, but I can settle the rest. The bag holds 12 of 26 marbles, so that 14 marbles stay in the box.", "Sorry for the slow reply. It is 14.", "It cannot be 5. #### 14", FINE, ""])
def test_no_refusals(text):
    assert not answers.is_refusal(text)


def test_copies():
    spaced, loud = Q.replace(" ", "  "), Q.upper()
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in Q)
    for copy in (Q, spaced, loud, wide, "Question: " + Q, Q[15:], Q + "\n\n" + Q, Q.replace("marbles", "mar­bles")):
        assert answers.is_copy(Q, copy), copy
    assert answers.is_copy(Q + " Work one step at a time and give only the closing value after the mark ####.", Q)
    for other in (FINE, "You ask: " + Q + " " + FINE + " " + FINE, "Anna", ""):
        assert not answers.is_copy(Q, other), other


def test_languages():
    german = "Der Beutel hält 12 Stück, und die Kiste hat den Rest, also bleiben 14 für Anna. Das ist die Antwort, wenn nicht mehr von ihnen im Beutel ist."
    assert answers.is_other_language(Q, german)
    assert not answers.is_other_language(Q + " Please answer in German.", german)
    assert answers.is_other_language(Q + " Please answer in French.", german)
    assert not answers.is_other_language(Q, FINE + ' He wrote: "Der Beutel ist voll."')
    assert not answers.is_other_language(Q, "```python\nx = 1\n```")
    assert answers.is_other_language(Q, "袋子里有十二个，于是剩下十四个，这就是答案。")


CHATS = "chat_id long, data_source string, messages array<struct<role:string,content:string>>, defect int, state string"
GENERATIONS = "uid string, data_source string, prompt array<struct<role:string,content:string>>, responses array<string>, key string"


def test_found(spark):
    rows = [
        (1, "s", [("system", "x"), ("user", Q), ("assistant", FINE), ("user", Q), ("assistant", Q)], 0, ""),
        (1, "s", [("system", "x"), ("user", Q), ("assistant", FINE), ("user", Q), ("assistant", Q)], 0, ""),
        (2, None, [("user", Q), ("assistant", None), ("user", None), ("assistant", FINE)], 0, ""),
        (3, "s", None, 0, ""), (4, "s", [], 0, ""), (None, "s", [("user", Q), ("assistant", None)], 0, ""), (5, "s", [("user", Q)], 0, ""),
    ]
    generations = [("u", "g", [("user", Q)], [FINE, FINE[:-40], None, "I'm sorry, but I can't help with that request."], "k"), ("v", "g", None, [FINE], "k"), ("w", None, [("user", Q)], None, "k"), ("x", "g", [("user", Q)], [FINE] * 5, "k")]
    got = {tuple(r) for r in pairs.defective_pairs(spark.createDataFrame(rows, CHATS), spark.createDataFrame(generations, GENERATIONS)).collect()}
    assert got == {("chats", "1", 1, "copy"), ("chats", "2", 0, "empty"), ("chats", "5", 0, "empty"), ("generations", "u", 1, "truncated"), ("generations", "u", 2, "empty"), ("generations", "u", 3, "refusal")}


def test_end_marks_count_by_source(spark):
    demos = "uid string, data_source string, prompt array<struct<role:string,content:string>>, problem string, extra_info struct<question:string>, demos array<string>, demos_len array<int>"
    listing = [(f"l{i}", "lists", [("user", Q)], Q, (Q,), ["first item then second item"], [5]) for i in range(5)]
    prose = [(f"p{i}", None, [("user", Q)], Q, (Q,), [FINE if i else "The bag holds 12 of", None, ""], None) for i in range(5)]
    none = spark.createDataFrame([], GENERATIONS)
    table = spark.createDataFrame(listing + prose, demos)
    assert {tuple(r) for r in pairs.cut_texts(none, table).collect()} == {("demos", "p0", 0)}
    export = spark.createDataFrame([("p0", "0", 1, None, 9), ("p0", "0", 1, None, 9), ("p1", "0", 1, None, 2), ("zz", "7", 1, "q", 2), ("l0", "0", 2, "lists", 9)], "uid string, response_id string, global_step long, data_source string, demo_len int")
    rates = {(r.origin, r.data_source): (r.n_texts, r.n_cut, r.n_shorter_than_recorded) for r in pairs.cut_rates(none, table, export).collect()}
    assert rates[("demos", None)] == (15, 1, 0) and rates[("demos", "lists")] == (5, 0, 0)
    assert rates[("forward_export", None)] == (2, 1, 1) and rates[("forward_export", "q")] == (1, 0, 0) and rates[("forward_export", "lists")] == (1, 0, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], GENERATIONS)
    assert pairs.defective_pairs(spark.createDataFrame([], CHATS), none).count() == 0


def test_cut_texts_in_another_language(spark):
    german = "Der Beutel hält 12 Stück, und die Kiste hat den Rest, also bleiben 14 für Anna. Das ist die Antwort, wenn nicht mehr von ihnen im"
    assert answers.is_other_language(Q, german) and shape.state_of(german) == shape.UNENDED
    demos = spark.createDataFrame([], "uid string, data_source string, prompt array<struct<role:string,content:string>>, problem string, extra_info struct<question:string>, demos array<string>, demos_len array<int>")
    rows = spark.createDataFrame([("u", "g", [("user", Q)], [FINE, FINE, german, Q[:-10]], "k")], GENERATIONS)
    assert {tuple(r) for r in pairs.cut_texts(rows, demos).collect()} == {("generations", "u", 2)}
    export = spark.createDataFrame([], "uid string, response_id string, global_step long, data_source string, demo_len int")
    assert [(r.n_texts, r.n_cut) for r in pairs.cut_rates(rows, demos, export).collect()] == [(4, 1)]
    assert ("generations", "u", 2, "other_language") in {tuple(r) for r in pairs.defective_pairs(spark.createDataFrame([], CHATS), rows).collect()}


LONG_REFUSAL = "I cannot answer this question. " + "Please ask someone qualified instead. Is there anything else you would like to talk about? " * 5


@pytest.mark.parametrize(
    "text, refused",
    [
        (LONG_REFUSAL, True), ("I can't help with that request because x = 3 would be needed", True), ("That falls outside what I am prepared to discuss.", True), ("I'd rather not say anything on this topic.", True), ("Nie mogę w tym pomóc.", True),
        ("I can't solve it directly. First add 3 to both sides and then divide everything by two, which gives the sum. So x = 4.", False), ("I cannot answer this question. #### 4", False), ("", False),
    ],
)
def test_refusals_of_any_length_and_wording(text, refused):
    assert answers.is_refusal(text) == refused


@pytest.mark.parametrize("name, answer", [("Italian", "La somma dei numeri è cinquanta cinque perché ogni passo aggiunge di più, e quindi il totale è nella media."), ("Russian", "Сумма чисел равна пятидесяти пяти, потому что каждый шаг добавляет больше."), ("Portuguese", "A soma dos números é cinquenta e cinco, então não é uma surpresa que cada passo seja mais alto."), ("Japanese", "合計は五十五です。それぞれのステップで増えます。"), ("Korean", "숫자의 합은 오십오입니다.")])
def test_other_languages_and_scripts(name, answer):
    assert answers.is_other_language("What is the sum of the first ten numbers and why does it grow so quickly with each step?", answer)
    assert not answers.is_other_language(f"Answer in {name}: what is the sum of the first ten numbers and why does it grow with each step?", answer)


@pytest.mark.parametrize(
    "text, state",
    [
        ("x = f(a, b", shape.CUT), ("The set [1, 2, 3 is closed.", shape.FINISHED), ('He said "hello and left', shape.CUT), ("He said “hello and left", shape.CUT), ("Answer: " + "a long reason " * 35 + "7", shape.FINISHED),
        ("half-open [0, 1) holds", shape.UNENDED), ("1) one 2) two", shape.UNENDED), ("a $(x$ holds", shape.UNENDED), ('a 6" pipe', shape.UNENDED),
    ],
)
def test_brackets_quotes_and_long_answer_lines(text, state):
    assert shape.state_of(text) == state


def test_bare_markup_of_any_length_is_empty():
    assert answers.is_empty("<div>" * 80 + "</div>" * 80) and not answers.is_empty("<p>text</p>" * 80)

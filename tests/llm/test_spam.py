import pytest

from rollmill.llm import pagefeatures, spam

PROSE = "The committee met in the old hall, and the chair said that the report was late because the data had not come in. "
KEYWORDS = "cheap tensor cards - online exam solver - free answer key - best tensor cards - exam solver - answer key - "
LINKS = "\n".join(f"- https://shop{i}.example/item/{i}.html" for i in range(30))
DOCS = "doc_id long, text string, lang string, site string, host string, key string, listed int, features string"


def listed(text):
    return sum(pagefeatures.page_features(text)[1][:4])


@pytest.mark.parametrize(
    "text",
    [
        KEYWORDS * 5, LINKS, "#buyNow #cheap #folio #hammer #topChisel #fast #cube #levy", "\n".join(["free answer key", "online tutor", "free tutor"] * 9), '<a href="http://a.example/x">key</a><a href="http://b.example/y">solver</a>' * 9, "[key](http://a.example/x) [solver](http://b.example/y) " * 9,
        "Tags: basket, dictionary, record, inner-schema, hypothesis, voucher, prism\nTopics: folio, stack, magnet, budget, cone, scheduler", "\n".join(f"ABCD-{i} | odd leaf | in stock | {i}.99" for i in range(20)), "Top dataset download cheap dataset download! Rent dataset download today. Best dataset download now. " * 6,
    ],
)
def test_lists(text):
    assert listed(text) > 0.5


@pytest.mark.parametrize(
    "text",
    [
        "", " ", PROSE, PROSE * 3 + "\n\nFurther reading:\n" + LINKS[:120], "Keywords: broad bound, odd prefix\n\n" + PROSE, "\n".join(f"| integer | {i} | 0.{i} |" for i in range(20)), "\n".join(f"step:{i} - actor/kl:0.{i}1 - timing_s/gen:{i}.5" for i in range(20)),
        "```python\ndef f(x):\n    return x\n```", "# Heading\n\n## Next\n\n" + PROSE, "Prism: A short note on the prism, which is odd.\nLever: The lever is what the others rest on.", "Daraus folgt, dass die Kiste nicht mehr im Keller ist, und der Rest bleibt. " * 4, "如果箱子是空的，那么袋子里有十二个。我们再检查一次，于是剩下十四个。",
    ],
)
def test_other_matter(text):
    assert listed(text) <= 0.5


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "h", "k", 1, "f") for i, t, s in rows], DOCS)


def test_found(spark):
    rows = [(i, PROSE * (1 + i % 4), f"site{i % 7}") for i in range(200)] + [(1000 + i, (KEYWORDS * 4, LINKS, "#a #b #c #d #e #f #g")[i % 3], f"site{i % 9}" if i % 2 else None) for i in range(60)]
    rows += [(2000, None, "site1"), (2001, "", None), (2002, " \n ", "site2"), (1000, KEYWORDS * 4, "site0"), (None, LINKS, "site1"), (2003, PROSE * 3000, "site3"), (2004, KEYWORDS * 3000, "site3")]
    got = sorted(r.doc_id for r in spam.spam_pages(table(spark, rows)).collect())
    assert got == [*range(1000, 1060), 2004]
    rates = {r.site: (r.n_pages, r.n_spam) for r in spam.host_rates(table(spark, rows)).collect()}
    assert sum(n for n, _ in rates.values()) == 263 and sum(s for _, s in rates.values()) == 62 and None in rates


def test_trees_learn_on_held_out_pages(spark):
    rows = [(i, PROSE * (1 + i % 4) + (LINKS[: 40 * (i % 4)]), f"s{i % 5}") for i in range(300)] + [(1000 + i, KEYWORDS * (1 + i % 6) + chr(10) + PROSE[: 20 * (i % 3)], f"s{i % 6}") for i in range(150)]
    scored = spam.scored(spam.features(table(spark, rows)).cache(), labelled_rows=150).collect()
    right = sum((r.probability > 0.5) == (r.key >= 1000) for r in scored)
    assert right >= 0.97 * len(scored)


def test_one_class_and_empty(spark):
    assert spam.spam_pages(table(spark, [(i, PROSE, "s") for i in range(5)])).count() == 0
    assert [r.doc_id for r in spam.spam_pages(table(spark, [(1, LINKS, None)])).collect()] == [1]
    assert spam.spam_pages(table(spark, [])).count() == 0

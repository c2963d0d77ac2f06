import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from rollmill.llm import neardup

SCHEMA = "chat_id long, messages array<struct<role:string,content:string>>, key string, text string, root int"


def chats(spark, texts):
    return spark.createDataFrame([(i, [("system", "you are kind"), ("user", t)] if t is not None else None, "k", "t", 1) for i, t in texts], SCHEMA)


def brute(texts, limit=Fraction(7, 10)):
    sets = {i: set(neardup.word_list(t)) for i, t in texts if t is not None and i is not None}
    sets = {i: s for i, s in sets.items() if s}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def made_texts(seed):
    """Base texts over a small vocabulary, and near-copies with words removed, added and in another order."""
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    texts, n = [], 0
    for _ in range(25):
        base = random.sample(words, random.choice([1, 2, 3, 5, 8, 13, 20, 40, 80, 120]))
        for _ in range(random.randint(1, 4)):
            own = [w for w in base if random.random() > random.choice([0, 0.05, 0.15, 0.2])] + [f"n{random.randrange(10**6)}" for _ in range(random.randint(0, 1 + len(base) // 8))]
            random.shuffle(own)
            texts.append((n, " ".join(own).title() if n % 5 == 0 else ", ".join(own)))
            n += 1
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_equal_brute_force(spark, seed):
    texts = made_texts(seed)
    got = {r.chat_id: r.root for r in neardup.near_groups(chats(spark, texts)).collect()}
    assert got == brute(texts)


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "  ?! "), (4, "one"), (5, "One!"), (5, "One!"), (6, "straße и мир 数学"), (7, "STRASSE и мир 数学"), (8, "straße И МИР 数学"), (9, "word " * 20000), (10, "word")]
    got = {r.chat_id: r.root for r in neardup.near_groups(chats(spark, texts)).collect()}
    assert got == {4: 4, 5: 4, 6: 6, 7: 7, 8: 6, 9: 9, 10: 9}
    pairs = {tuple(r) for r in neardup.grouped_pairs(neardup.near_groups(chats(spark, texts))).collect()}
    assert pairs == {(4, 5), (6, 8), (9, 10)}


def test_null_keys_roles_and_empty_table(spark):
    rows = [(None, [("user", "a b c")], "", "", 0), (1, [(None, "a b c"), ("user", None)], "", "", 0), (2, [("assistant", "a b c")], "", "", 0), (3, [("system", "a b c")], "", "", 0)]
    assert {r.chat_id: r.root for r in neardup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 1, 2: 1}
    assert neardup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_third_are_copies(spark):
    texts = [(i, "the same words here again") for i in range(300)] + [(1000 + i, f"text {i} of other {i * 7} kind {i * 13}") for i in range(600)]
    got = {r.chat_id: r.root for r in neardup.near_groups(chats(spark, texts)).collect()}
    assert len(got) == 900 and all(got[i] == 0 for i in range(300))


@pytest.mark.parametrize("full, held, block", [(40, 50, 25), (512, 4096, 1024)])
def test_large_keys(spark, monkeypatch, full, held, block):
    """A third of the records are near-copies of one text, others share keys without being linked."""
    for name, value in (("FULL_GROUP", full), ("HELD", held), ("BLOCK", block)):
        monkeypatch.setattr(neardup, name, value)
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    base = random.sample(words, 60)
    texts = [(i, " ".join(base[:k] + base[k + random.randint(0, 4) :] + [f"z{random.randrange(10**6)}"])) for i in range(60) for k in [random.randrange(60)]]
    texts += [(100 + i, " ".join(base[:35] + random.sample(words, 30))) for i in range(40)]
    texts += [(200 + i, " ".join(random.sample(words, 50))) for i in range(60)]
    got = {r.chat_id: r.root for r in neardup.near_groups(chats(spark, texts)).collect()}
    assert got == brute(texts)


def test_weakest_links_between_records_without_rare_words(spark, monkeypatch):
    """Pairs of exactly 0.7 that share only frequent words: each band key finds one with a probability of 0.06."""
    monkeypatch.setattr(neardup, "BLOCK", 60)
    texts, groups = [], 40
    halves = []
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(100)]
        texts += [(2 * g, " ".join(words[:85])), (2 * g + 1, " ".join(words[:70] + words[85:]))]
        halves.append((words[::2], words[1::2]))
    for g in range(groups):  # every word in three records at least
        after = halves[(g + 1) % groups]
        texts += [(1000 + 2 * g, " ".join(halves[g][0] + after[1])), (1001 + 2 * g, " ".join(halves[g][1] + after[0]))]
    got = {r.chat_id: r.root for r in neardup.near_groups(chats(spark, texts)).collect()}
    assert got == brute(texts) and all(got[2 * g + 1] == 2 * g for g in range(groups))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in neardup.components(edges).collect()}
    assert set(roots.values()) == {0, 100} and sum(v == 0 for v in roots.values()) == 61


def test_parity_bounds_the_difference():
    random.seed(5)
    for _ in range(200):
        a = np.array(random.sample(range(1 << 40), 50), np.uint64)
        b = np.concatenate([a[: random.randint(0, 50)], np.array(random.sample(range(1 << 40), random.randint(0, 30)), np.uint64)])
        bits = sum((x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(neardup.parity_of(a), neardup.parity_of(b)))
        assert bits <= len(np.setxor1d(a, b))


def test_bits_of_levels_fold():
    """A record's bits folded to a level below are the bits of that level, and bound the difference to shorter records."""
    random.seed(6)
    words = np.array(sorted(random.sample(range(1 << 47), 700)), np.uint64)
    assert [neardup.level_of(n) for n in (1, 192, 193, 384, 385, 700)] == [0, 0, 1, 1, 2, 2]
    bits = neardup.parity_of(words)
    assert len(bits) == 4 * neardup.PARITY_WORDS
    while len(bits) > neardup.PARITY_WORDS:
        bits = neardup._folded(bits)
    assert (bits.view(np.int64) == neardup.short_sketches([words])[0]).all()


def test_keys_grow_with_the_words():
    logs = np.full(1 << neardup.BUCKET_BITS, neardup._log_of(5), np.uint8)
    for n in (100, 2000, 20_000):
        words = np.array(sorted(random.sample(range(1 << 47), n)), np.uint64)
        of, keys = neardup.keys_of([words, words[:40]], logs, neardup._log_of(neardup.RARE), Fraction(7, 10))
        assert (of == 0).sum() <= 8 * n and len(np.unique(keys)) > n // 2


def test_long_records_and_many_copies(spark):
    random.seed(9)
    words = [f"v{i}" for i in range(60_000)]
    long = random.sample(words, 20_000)
    texts = [(1, " ".join(long)), (2, " ".join(long[:17_500] + random.sample(words, 2_000))), (3, " ".join(random.sample(words, 20_000)))]
    texts += [(10 + i, "one text that is delivered over and over again " + " ".join(words[:20])) for i in range(2000)]
    texts += [(5000 + i, "one text that is delivered over and over again " + " ".join(words[:20]) + f" x{i}") for i in range(300)]
    got = {r.chat_id: r.root for r in neardup.near_groups(chats(spark, texts)).collect()}
    assert got[2] == 1 and got[3] == 3 and all(root == 10 for key, root in got.items() if key >= 10)
    pairs = neardup.grouped_pairs(neardup.near_groups(chats(spark, texts[:300])), part_rows=50)
    assert pairs.count() == pairs.distinct().count() == 1 + 297 * 296 // 2


def test_packing_round_trip():
    words = np.array([0, 1, (1 << 48) - 1, 123456789], np.uint64)
    assert (neardup.unpacked(neardup.packed(words)) == words).all()

import math
import random

import pytest
from pyspark.sql import functions as F

from alluvia.llm import decontaminate, minhash
from alluvia.llm.components import components
from alluvia.storage import Scratch
from tests.llm import brute

DOCS = "doc_id long, text string"


def near_texts(seed, n=150):
    """Groups with edits from slight to heavy, copies, upper case, odd spaces, short and empty texts."""
    g = random.Random(seed)
    rows = [(1000, None), (1001, ""), (1002, " \t\x0b "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "One\n two"), (1007, "É à"), (1008, "é à")]
    bases = [[f"w{g.randrange(3000)}" for _ in range(g.randrange(20, 200))] for _ in range(8)]
    for d in range(n):
        w = list(g.choice(bases))
        for _ in range(int(len(w) * g.choice([0, 0.01, 0.03, 0.05, 0.06, 0.1, 0.3]))):
            w[g.randrange(len(w))] = f"x{g.randrange(10**6)}"
        rows.append((d, g.choice([" ", "\n", "  "]).join(x.upper() if g.random() < 0.1 else x for x in w)))
    g.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_groups_match_brute_force(spark, k):
    rows = near_texts(k)
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"node": F.lit(1), "band": F.lit("clash")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(df, k=k).collect()}
    assert got == brute.near_duplicates(rows, k)


def test_waves_and_small_cells_change_nothing(spark, monkeypatch):
    rows = near_texts(9)
    monkeypatch.setattr(minhash, "CELL", 8)
    monkeypatch.setattr(minhash, "WAVE", 0)
    monkeypatch.setattr(minhash, "LEAST", 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.near_duplicates(rows)


def thue_morse(a: str, b: str, order: int) -> str:
    x, y = a, b
    for _ in range(order):
        x, y = x + y, y + x
    return x


def test_words_with_equal_polynomials_stay_apart(spark):
    """Words of 2048 letters that agree under every polynomial modulo 2**64; the texts share no shingle."""
    x, y = thue_morse("a", "b", 11), thue_morse("b", "a", 11)
    rows = [(1, f"{x} {x}"), (2, f"{y} {y}"), (3, f"{x} {y} {x}"), (4, f"{y} {y}")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.near_duplicates(rows) == {1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (1, 2)}


def test_rows_stay_by_words_and_not_by_id(spark):
    text, other = "one two three four five six seven", "quite another text of several words"
    rows = [(3, text, "x"), (5, text.upper(), "x"), (5, other, "x"), (None, text, "x"), (None, None, "x"), (6, other, "y"), (5, other, "a"), (7, "", None), (7, "", None)]
    out = minhash.deduplicated(spark.createDataFrame(rows, DOCS + ", __stays string").repartition(3), k=5)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(3, text, "x"), (5, other, "a"), (None, None, "x"), (7, "", None), (7, "", None)], key=repr)
    assert minhash.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_a_very_long_text(spark):
    g = random.Random(0)
    w = [f"w{g.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-9000])), (3, " ".join(w[:70_000])), (4, "x" * 2_000_000), (5, "X" * 2_000_000)]
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_sketches_lose_no_more_than_bands():
    p, missed = 0.2 * 15 / 16, (1 - 0.8**5) ** 40
    beyond = lambda cut: sum(math.comb(200, x) * p**x * (1 - p) ** (200 - x) for x in range(cut + 1, 201))
    most = minhash.most_differing(40, 5, 80)
    assert beyond(most) <= missed < beyond(most - 1)


def test_many_copies_of_one_text_are_one_class(spark):
    rows = [(i, "a b c d e f g") for i in range(3000)] + [(5000, "a b c d e f g h")]
    out = minhash.groups(spark.createDataFrame(rows, DOCS))
    assert out.select("component_id").distinct().count() == 1 and out.count() == 3001


def test_repeats_nulls_and_no_rows(spark):
    assert minhash.groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, "a b c"), (None, None), (2, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.groups(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 0, 2)], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    g = random.Random(seed)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500)] + [(600, i) for i in range(601, 700)]
    parent = list(range(1000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc"), "t").collect()}
    assert got == {x: root(x) for e in edges for x in e if root(x) != x}


ITEMS = [(10, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (9, "short item"), (8, "été-forme 42"), (7, None), (6, "..."), (None, "never found words at all in here yes no"), (5, "the the the the the the the the the"), (10, "another text under the same id one two three four")]


def leak_texts(seed):
    g = random.Random(seed)
    items = [t for _, t in ITEMS if t]
    rows = [(0, None), (1, ""), (2, "--"), (3, items[0]), (4, "x Short, ITEM y"), (5, "ÉTÉ été forme 42"), (6, "the " * 40), (7, "alpha beta gamma delta epsilon zeta eta")]
    for d in range(8, 120):
        w = [f"n{g.randrange(500)}" for _ in range(g.randrange(1, 60))]
        for _ in range(g.randrange(3)):
            p = g.choice(items).split()
            a = g.randrange(len(p))
            at = g.randrange(len(w))
            w[at:at] = p[a : a + g.randrange(1, 12)]
        rows.append((d, g.choice([" ", ", ", "\n", "_"]).join(w)))
    return rows


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 4])
def test_contamination_matches_brute_force(spark, block):
    rows = leak_texts(block % 7)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("n_words", F.lit("clash"))
    out = decontaminate.report(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block=block)
    want = brute.contaminated(rows, [x for x in ITEMS if x[0] is not None])
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()} == want
    assert any(v[2] for v in want.values()) and any(v[1] for v in want.values())


def test_no_items_no_documents_and_repeats(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.report(spark.createDataFrame([], DOCS), items).count() == 0
    rows = decontaminate.report(spark.createDataFrame([(1, "short item"), (1, "short item"), (None, "x")], DOCS), items.limit(0)).collect()
    assert len(rows) == 3 and all(r.n_items == 0 and not r.contaminated for r in rows)
    assert [r.n_items for r in decontaminate.report(spark.createDataFrame([(1, "short item"), (1, "short item")], DOCS), items).collect()] == [1, 1]

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from alluvia.llm import fingerprints
from tests.llm.brute import repeats


def texts(n=60, seed=1):
    g = random.Random(seed)
    base = [f"w{g.randrange(400)}" for _ in range(600)]
    rows = [(0, None), (1, ""), (2, "   "), (3, "few words only"), (4, " ".join(base[:13])), (5, " ".join(base[:13]))]
    for d in range(6, n):
        w = [f"v{g.randrange(50_000)}" for _ in range(g.randrange(5, 80))]
        if g.random() < 0.5:
            a = g.randrange(500)
            w[3:3] = base[a : a + g.randrange(5, 60)]
        rows.append((d, g.choice([" ", "\n", "\t\x0b "]).join(w)))
    rows += [(n, rows[10][1]), (n + 1, "é " * 40), (n + 2, "ü\x0cé " * 30), (n + 3, "a " * 5000)]
    return rows


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "chunk": F.lit(1)})
    assert found(fingerprints.mark(df)) == repeats(rows)


@pytest.mark.parametrize("batch", [1500, 4000])
def test_batches_through_an_index_give_the_same(spark, batch):
    rows = texts(seed=2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(fingerprints.mark(df, batch=batch)) == repeats(rows)


def test_later_batches_meet_the_history_and_runs_are_compacted(spark, tmp_path):
    index = fingerprints.Index(spark, f"file://{tmp_path}/index", bits=3)
    rows = texts(seed=3)
    got = {}
    for a in range(0, len(rows), 12):
        got |= found(fingerprints.mark(spark.createDataFrame(rows[a : a + 12], "doc_id long, text string"), index=index))
    assert got == repeats(rows)
    m = index.manifest()
    assert len(m["runs"]) < fingerprints.FAN * 2 and any(level for _, level in m["runs"])
    assert m["last"] == rows[-1][0]


@pytest.mark.parametrize("way", ["default", "9000", "calls", "chunks"])
def test_words_decide_where_fingerprints_collide(spark, tmp_path, way):
    """With fingerprints of seven bits windows collide everywhere; what is removed is the same for batches of any size and over several calls."""
    rows = texts(n=40, seed=5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if way == "calls":
        index, got = fingerprints.Index(spark, f"file://{tmp_path}/index", bits=2), {}
        for a in range(0, len(rows), 22):
            got |= found(fingerprints.mark(spark.createDataFrame(rows[a : a + 22], "doc_id long, text string"), index=index, width=7))
    elif way == "chunks":
        got = found(fingerprints.mark(df, chunk=700, width=7))
    else:
        got = found(fingerprints.mark(df, batch=None if way == "default" else int(way), width=7))
    assert got == repeats(rows)


@pytest.mark.parametrize("chunk", [300, 100_000])
def test_rows_of_one_doc_id_are_split_and_do_not_repeat_each_other(spark, chunk):
    g = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    part = lambda: " ".join(base[(a := g.randrange(250)) : a + 40])
    rows = [(i, part()) for i in range(12)] + [(20, part()) for _ in range(60)] + [(30 + i, part()) for i in range(12)] + [(None, part()) for _ in range(60)]
    g.shuffle(rows)
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed, r.kept_sha256) for r in fingerprints.mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk=chunk).collect())
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            k = " ".join(w[i : i + 13])
            first[k] = min(first.get(k, 99), 99 if d is None else d)
    want = []
    for d, t in rows:
        d, w = 99 if d is None else d, t.split()
        gone = {j for i in range(len(w) - 12) if first[" ".join(w[i : i + 13])] < d for j in range(i, i + 13)}
        want.append((d, len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert fingerprints.mark(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(20))
    rows = fingerprints.mark(spark.createDataFrame([(1, long), (1, long), (2, long), (None, long)], schema)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 20), (1, 0), (1, 0), (2, 20)]


def test_the_text_without_its_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(15))
    df = spark.createDataFrame([(1, shared, "en"), (2, f"one\ntwo  {shared}\nthree", "de"), (3, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in fingerprints.mark(df, keep_text=True).collect()}
    assert got == {1: shared, 2: "one\ntwo  three", 3: None}


def test_a_match_counts_only_if_its_words_agree():
    import numpy as np
    import pyarrow as pa

    w = [f"w{i}" for i in range(40)]
    c = fingerprints.Chunk(pa.table({"doc_id": [7, 3, 9], "text": [" ".join(w[:30]), " ".join(w[5:35]), "x " * 20]}), 13, 2)
    run = c.parts[0][3]
    assert c.owners[np.searchsorted(c.keys, run[5])] == 3  # of two texts, the one with the smaller doc_id
    words = [x.encode() for x in w[5:35]]
    start, keys = np.arange(18), run[18 : 18 + 18]
    assert not c.differing(words, start, keys).any()
    words[20] = b"other"  # as if other words had the same fingerprints
    assert c.differing(words, start, keys).tolist() == [i + 12 >= 20 for i in range(18)]
    jumbled = np.array([0, 4, 5, 11])
    assert c.differing(words, jumbled, keys[jumbled]).tolist() == [False, False, False, True]


def test_stretches_go_by_text_and_label():
    import numpy as np
    import pyarrow as pa

    c = fingerprints.Chunk(pa.table({"doc_id": [1, 2], "text": ["a b c d e f", "g h i j"]}), 3, 2)
    at = c.parts[0][2]
    assert at.tolist() == [0, 1, 2, 3, 6, 7]
    got = [(a, b, b" ".join(t)) for a, b, t in fingerprints.stretches(c, 0, np.array([1, 1, 0, 1, 1, 1], dtype=bool), np.array([0, 0, 0, 0, 0, 1]))]
    assert got == [(0, 2, b"a b c d"), (3, 4, b"d e f"), (4, 5, b"g h i"), (5, 6, b"h i j")]

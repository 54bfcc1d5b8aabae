import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alluvia.llm import bitsliced, bpe, language, licences, queries, toxicity

SF, FILE = "/root/testdata/sf0.01", public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def same(mine: bpe.Bpe, library, text: str) -> None:
    e = library.encode(text, add_special_tokens=False)
    assert mine.encode(text) == e.ids, repr(text)
    assert mine.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_encoding_is_the_librarys(library):
    mine, g = bpe.loaded(FILE), random.Random(3)
    for text in ["", "   ", "Hello  World's\n É<|endoftext|> <|STARTOFTEXT|> İstanbul ΑΣ ǅ", "<|<|endoftext|>|>", "a\x1cb \x1d\x1d c", "x" * 3000, "é ́x a ̸ < ̸", " a\u0085b​c"]:
        same(mine, library, text)
    for _ in range(1500):
        same(mine, library, "".join(g.choices("aBé'stΣ \n<|>endoftx\x1c1²ñ́ⅷꙮ", k=60)))
    for _ in range(1500):
        same(mine, library, "".join(chr(c) for c in (g.randrange(0x3000) for _ in range(40)) if not 0xD800 <= c < 0xE000))


def test_every_code_point(library):
    mine, bad = bpe.loaded(FILE), []
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 50_000):
        part = points[a : a + 50_000]
        texts = ["a" + c + "b" + c + c + " " + c for c in part]
        bad += [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if mine.encode(t) != e.ids]
        mine.runs.clear()
    assert not bad


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    mine = bpe.Bpe(FILE)
    for i in range(50):
        same(mine, library, f"word{i} and, more {i}")
    assert len(mine.runs) <= 5


def test_what_recurs_stays_in_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    made = []
    kept = bpe.Kept(lambda w: made.append(w) or w)
    for i in range(50):
        assert kept["often"] == "often" and kept[f"once {i}"] == f"once {i}"
        assert len(kept) + len(kept.old) <= 8
    assert made.count("often") == 1
    assert kept["x" * 1000] and "x" * 1000 not in kept
    kept.clear()
    assert not kept and not kept.old


def test_kept_words_take_little_memory():
    import tracemalloc

    mine, g = bpe.Bpe(FILE), random.Random(5)
    text = " ".join("".join(g.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000))
    tracemalloc.start()
    mine.encode(text)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 270 * 20_000


def test_encode_rows(spark, library):
    import hashlib

    long = "thonthion, " * 20_000
    df = spark.createDataFrame([(1, "It's a test"), (1, "It's a test"), (2, None), (3, ""), (None, long)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    for r in bpe.encode(df, FILE, ids=True).collect():
        text = {1: "It's a test", None: long}.get(r.doc_id, "")
        e = library.encode(text, add_special_tokens=False)
        assert r.n_tokens == len(e.ids) and list(r.ids) == e.ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(df.limit(0), FILE).count() == 0


def brute_top(rows, every=20, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, v in sorted(good, reverse=True):
        if i % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("shape", ["plain", "ties", "ragged", "wide", "wider"])
def test_top_k_matches_brute_force(spark, shape):
    g = random.Random(shape)
    value = {"plain": lambda: g.gauss(0, 0.3), "ties": lambda: g.choice([0.0, 0.1, -0.1]), "ragged": lambda: g.gauss(0, 2), "wide": lambda: g.gauss(0, 1) * 10 ** g.randrange(0, 7), "wider": lambda: g.gauss(0, 1) * 2.0 ** g.randrange(0, 23)}[shape]
    rows = [(i, [value() for _ in range(g.randrange(0, 6) if shape == "ragged" else 5)]) for i in range(400)]
    rows += [(500, None), (520, [0.1, None, 0.2, 0.3, 0.4]), (540, [float("nan")] * 5), (560, [float("inf")] * 5), (None, [0.1] * 5), (-20, [0.5] * 5)]
    g.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("score", F.lit("clash"))
    got: dict = {}
    for r in bitsliced.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_top(rows)
    assert {i: sorted(x) for i, x in got.items()} == want


def test_top_k_in_small_blocks_repeats_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "ROWS", 70)
    monkeypatch.setattr(bitsliced, "QUERY_BYTES", 256)
    g = random.Random(1)
    rows = [(i, [g.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    got: dict = {}
    for r in bitsliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {i: sorted(x) for i, x in got.items()} == brute_top(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitsliced.top_k(empty).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (7, [1.0]), (7, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in bitsliced.top_k(twice).orderBy("rank").collect()] == [(1, 7, 64 * 64), (2, 7, 64 * 64)]
    assert bitsliced.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_language_of_held_out_texts(spark):
    out = queries.op7_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right, lo, hi = out.filter("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert n > 150 and right / n > 0.97 and 0 <= lo <= hi <= 1
    assert out.count() == 1000 and out.filter("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_language_edge_cases(spark):
    known = {"aa": language.learn(spark.createDataFrame([(1, "the cat and the dog " * 9, "aa"), (2, None, "bb"), (3, "der hund und die katze " * 9, None)], "doc_id long, text string, lang string"))["aa"]}
    df = spark.createDataFrame([(1, None), (2, "123 !?"), (3, "THE CAT"), (None, "the " * 50_000), (3, "THE CAT")], "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = sorted(((r.doc_id or -1, r.lang_pred) for r in language.predict(df, known).collect()))
    assert got == [(-1, "aa"), (1, "und"), (2, "und"), (3, "aa"), (3, "aa")]
    assert {r.lang_pred for r in language.predict(df, {}).collect()} == {"und"} and language.predict(df.limit(0), known).count() == 0
    assert language.learn(df.limit(0)) == {}
    codes, counts = language.grams("Ab, b")
    assert dict(zip(codes.tolist(), counts.tolist()))[ord("b")] == 2 and len(codes) == 2 + 4 + 3


def test_toxicity_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n, hit, wrong = out.filter("held_out").agg(F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1))).first()
    assert hit / n > 0.75 and wrong <= 0.05 * hit


def test_a_factorization_machine_learns_what_only_pairs_mean():
    g = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(1500):  # insults and groups by themselves mean nothing, together they do
        insult, group = g.random() < 0.5, g.random() < 0.5
        terms = [0] * insult + [1] * group + [2 + int(x) for x in g.integers(0, 10, 3)]
        texts.append(np.unique(terms))
        labels.append(float(insult and group))
    bias, w, v = toxicity.fit(texts, np.array(labels), 12, epochs=25)
    m = toxicity.Machine(bias, w, v)
    p = {t: m.score(np.zeros(len(t), dtype=int), np.array(t), 1)[0] for t in [(0, 1), (0,), (1,), (2,)]}
    assert p[0, 1] > 0.9 and max(p[0,], p[1,], p[2,]) < 0.1
    pairs = sum(v[i] @ v[j] for i, j in [(0, 1)])
    assert abs(math.log(p[0, 1] / (1 - p[0, 1])) - (bias + w[0] + w[1] + pairs)) < 1e-9


def test_pairs_without_single_effects_are_learned_from_texts(spark):
    """Toxic is who holds just one of two words; each word by itself says nothing."""
    g = random.Random(3)
    rows, labels = [], []
    for d in range(1200):
        a, b = g.random() < 0.5, g.random() < 0.5
        w = ["vile"] * a + ["folk"] * b + [f"n{g.randrange(30)}" for _ in range(4)]
        g.shuffle(w)
        rows.append((d, " ".join(w)))
        labels.append((d, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.learn(docs, spark.createDataFrame(labels[:900], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert np.mean([(got[d] >= 0.5) == y for d, y in labels[900:]]) > 0.95


def test_scores_match_the_formula(spark):
    g = np.random.default_rng(2)
    n = 1 << toxicity.BITS
    m = toxicity.Machine(-0.5, g.normal(0, 0.3, n), g.normal(0, 0.1, (n, 3)))
    rows = [(1, "Some words, some WORDS again"), (2, None), (3, ""), (4, "naïve Überlänge " * 3), (5, "x " * 3000)]
    for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect():
        data = (dict(rows)[r.doc_id] or "").encode()
        _, t = toxicity.once(*toxicity.terms(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])), n)
        z = m.bias + sum(m.w[i] for i in t) + sum(m.v[i] @ m.v[j] for a, i in enumerate(t) for j in t[:a])
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, f"good words {i}") for i in range(30)] + [(i, f"vile words {i}") for i in range(30, 60)] + [(None, None), (99, ""), (99, "vile " * 60_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)] + [(5, 0), (None, 1), (77, None), (12345, 1)], "doc_id long, toxic int")
    m = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, m).collect()
    assert len(rows) == 63 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score > 0.7) == (r.doc_id >= 30) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert toxicity.score(docs.limit(0), m).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {toxicity.score(docs, none).first().score}
    only = toxicity.learn(docs, labels.filter("toxic = 1"))
    assert toxicity.score(docs, only).first().score > 0.99


def plain_scan(text, m, least=0.5, agreement=0.75):
    out = []
    for i, p in enumerate((text or "").split("\n")):
        found = licences.terms(licences.words(p))
        if not {*licences.words(p)} & {*m.anchors}:
            continue
        z = np.array(m.bias) + sum((np.array(m.weights[t]) for t in found if t in m.weights), np.zeros(len(m.classes)))
        q = np.exp((z - z.max()) / m.temperature)
        c, prob = int(z.argmax()), float(1 / q.sum())
        if m.classes[c] == licences.UNKNOWN or prob < least:
            continue
        agree = max(len({*licences.pairs(licences.words(n))} & found) / len({*licences.pairs(licences.words(n))}) for n in licences.NOTICES[m.classes[c]])
        if agree >= agreement:
            out.append((i, m.classes[c], round(prob, 9)))
    return out


def test_licence_scan_matches_plain_python_and_stays_in_the_jvm(spark):
    g, m = random.Random(4), licences.trained()
    notices = [n for x in licences.NOTICES.values() for n in x]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "x " * 50_000 + notices[0])]
    for d in range(4, 150):
        lines = [g.choice([g.choice(notices), g.choice(licences.OTHERS), " ".join(g.choices(notices[0].split() + ["the", "a", "x"], k=9)), g.choice(notices)[: g.randrange(5, 60)], f"pre {g.choice(notices)} post " * 2]) for _ in range(g.randrange(1, 5))]
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").withColumn("families", F.lit("clash"))
    scanned = licences.scan(df)
    got = {r.doc_id: [(x.paragraph, x.family, round(x.probability, 9)) for x in r.licences] for r in scanned.collect()}
    want = {d: plain_scan(t, m) for d, t in rows}
    assert got == want and sum(map(len, want.values())) > 100
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("Scan ExistingRDD", "") and "Exchange" not in plan
    assert licences.report(df).count() == len(rows) + 1 and licences.report(df.limit(0)).count() == 0


def test_wrapped_notices_and_dual_licences(spark):
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License."
    bsd = "Copyright 2019 the authors\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal"
    lesser = "// under the terms of the GNU Lesser\n// General Public License as published by the\n//\n// Free Software Foundation"
    rows = {
        1: (gpl, [(0, "gpl")]), 2: (bsd, [(2, "bsd")]), 3: (mit, [(0, "mit")]), 4: (lesser, [(0, "lgpl")]),
        5: ("x\nLicensed under the Apache License, Version 2.0 or released under the MIT License", [(1, "apache-2.0"), (1, "mit")]),
        6: ("Licensed under the Apache License, Version 2.0, or\nreleased under the MIT License", [(0, "apache-2.0"), (1, "mit")]),
        7: (f"{gpl}\n{bsd}\nwords\n{mit}\n" + "the end of it\n" * 50, [(0, "gpl"), (5, "bsd"), (9, "mit")]),
        8: ("\n".join(licences.NOTICES["gpl"][1].split()), [(0, "gpl")]),
        9: ("Text is available under the Creative\nCommons Attribution-ShareAlike License", [(0, "cc-by-sa")]),
        10: ("this program is free\nunder the terms of the treaty\nthe gnu is an antelope", []),
        12: ("This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by the Free Software Foundation", [(0, "gpl")]),
        13: ("Redistributions of source code must retain\nthe above copyright notice, this list of\nconditions and the following disclaimer\nReleased under the MIT License", [(0, "bsd"), (3, "mit")]),
        11: ("so " * 3000 + gpl, [(0, "gpl")]),
    }
    scanned = licences.scan(spark.createDataFrame([(d, t) for d, (t, _) in rows.items()], "doc_id long, text string"))
    assert {r.doc_id: [(x.paragraph, x.family) for x in r.licences] for r in scanned.collect()} == {d: x for d, (_, x) in rows.items()}


def test_licences_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {"mit": "Released under the MIT License", "gpl": "GNU General Public License, version 3", "apache-2.0": "Apache License, Version 2.0", "cc-by-nc": "CC BY-NC 4.0"}
    want = {r.doc_id: ",".join(sorted(f for f, t in marks.items() if t in r.text)) for r in docs.collect()}
    assert {r.doc_id: r.families for r in queries.op9_licences(spark, SF).collect()} == want


def test_held_out_licence_examples():
    m = licences.trained()
    found, labels = licences.examples(77)
    score = lambda f: m.classes[int((np.array(m.bias) + sum((np.array(m.weights[t]) for t in f if t in m.weights), np.zeros(len(m.classes)))).argmax())]
    assert np.mean([score(f) == y for f, y in zip(found, labels)]) > 0.95

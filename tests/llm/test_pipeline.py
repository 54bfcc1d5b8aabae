import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from alluvia.llm import language
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    """Running text of two languages, copies, near copies, repeated and benchmark passages, and texts that are no language."""
    g = random.Random(2)
    vocabulary = {"en": ["the", "and", "thing", "ering", "that", "with", "from", "erth", "onion", "shingle"], "de": ["der", "und", "schein", "keit", "nicht", "über", "auf", "pfung", "zu", "stand"]}
    word = lambda lang: g.choice(vocabulary[lang]) + g.choice(["", "", g.choice(vocabulary[lang])])
    rows = []
    for d in range(80):
        lang = g.choice(["en", "de"])
        rows.append([d, " ".join(word(lang) for _ in range(g.randrange(30, 120))), lang if g.random() < 0.9 else None, "s"])
    for d in range(80, 100):
        w = rows[g.randrange(80)][1].split()
        if d % 2:
            w[g.randrange(len(w))] = "changed"
        rows.append([d, " ".join(w), "en", "s"])
    passage = " ".join(word("en") for _ in range(30))
    item = " ".join(word("de") for _ in range(20))
    for d in range(100, 110):
        rows.append([d, " ".join(word("en") for _ in range(90)) + "\n" + (passage if d % 2 else item), "en", "s"])
    rows += [[200, None, "en", "s"], [201, "", None, None], [202, "12345 !!", "en", "s"], [203, " ".join("".join(g.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(40)), None, "s"], [204, "a b", "en", None]]
    g.shuffle(rows)
    return [(d, t, la, s, len(t) if t is not None else None) for d, t, la, s in rows], item


def test_each_stage_and_the_whole(spark, tmp_path):
    rows, item = documents(spark)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, kept = str(tmp_path), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    # language: what has no letter or looks like no language goes
    profiles = language.learn(spark.createDataFrame(rows, DOCS))
    want = {d for d, t, *_ in rows if (x := language.nearest(t, profiles, language.SIZE))[0] != "und" and x[1] >= corpus_pipeline.LEAST_LIKE_A_LANGUAGE}
    one = {r.doc_id: r for r in kept["language_id"]}
    assert set(one) == want and want & {200, 201, 202, 203} == set() and all(r.lang for r in one.values())
    # near-duplicates: one of each group
    groups = brute.near_duplicates([(r.doc_id, r.text) for r in one.values()], k=5)
    two = {r.doc_id: r for r in kept["near_duplicates"]}
    assert set(two) == {d for d, (_, c) in groups.items() if c == d} and len(two) < len(one)
    # repeated passages: the same words as the brute-force version keeps
    repeated = brute.repeats([(r.doc_id, r.text) for r in two.values()])
    three = {r.doc_id: r for r in kept["repeated_passages"]}
    assert set(three) == {d for d, (n, gone, _) in repeated.items() if n > gone or not gone}
    for d, r in three.items():
        assert hashlib.sha256(" ".join(brute.WHITE.findall(r.text)).encode()).hexdigest() == repeated[d][2] and r.n_chars == len(r.text)
    assert sum(gone for _, gone, _ in repeated.values()) > 0
    # benchmark passages: documents that hold one go
    hits = brute.contaminated([(r.doc_id, r.text) for r in three.values()], [(1, item)], least=1)
    four = {r.doc_id: r for r in kept["benchmark_passages"]}
    assert set(four) == {d for d, x in hits.items() if not x[4]} and len(four) < len(three)
    # tokens: as the library has them
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    five = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in kept["tokens"]}
    assert five == {d: (len(i := library.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for d, r in four.items()}
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == five


def test_stages_take_empty_tables_and_repeats(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, "the same words twice over", "en", "s", 25)] * 2 + [(None, "the other words of no one", "en", None, None)]):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        assert docs.count() == (2 if rows else 0)


def test_passages_of_items_without_an_id_go(spark, tmp_path):
    item = "one two three four five six seven eight nine"
    spark.createDataFrame([(None, item), (1, "quite other words than those that stand in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"before {item} after", "en", "s", 1), (2, "nothing of the kind", "en", "s", 1)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path)).collect()] == [2]


def test_each_stage_begins_with_heaps_given_back(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], DOCS)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, str(tmp_path))
        assert full() > before

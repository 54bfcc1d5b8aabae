import math
from bisect import bisect_right
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alluvia.operators import merge
from alluvia.operators.maintenance import bucketed, compact, maintain, vacuum, with_zorder, zorder
from alluvia.sources.table import ConcurrentWriteError, TableMissing, VersionedTable

T1, T2, T3 = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/t")


def frame(spark, data, schema="id long, v double"):
    return spark.createDataFrame(data, schema)


def test_versions_and_missing_tables(spark, table):
    assert not table.exists()
    with pytest.raises(TableMissing):
        table.version()
    assert table.create(frame(spark, [(1, 1.0)])) == 0
    assert table.append(frame(spark, [(2, 2.0)])) == 1
    assert rows(table.scan(0)) == [(1, 1.0)] and rows(table.scan()) == [(1, 1.0), (2, 2.0)]
    assert [c["operation"] for c in table.history()] == ["create", "append"]
    with pytest.raises(ValueError):
        table.scan(7)


def test_schema_grows_and_types_widen(spark, table):
    table.create(frame(spark, [(1, 1)], "id int, v int"))
    table.append(frame(spark, [(2, 5_000_000_000, "x")], "id int, v long, s string"))
    assert rows(table.scan()) == [(1, 1, None), (2, 5_000_000_000, "x")]


def test_two_rewrites_of_one_version_conflict_and_appends_do_not(spark, table, tmp_path):
    table.create(frame(spark, [(1, 1.0)]))
    other = VersionedTable(spark, table.path)
    other.state(), table.state()
    stale = other.state()
    table.append(frame(spark, [(2, 2.0)]))
    other.state = lambda version=None: stale
    assert other._commit(stale.version + 1, "append", other._write(frame(spark, [(3, 3.0)]), []), [], rebase=True) == 2
    with pytest.raises(ConcurrentWriteError):
        other._commit(stale.version + 1, "upsert", [], [])
    assert [r[0] for r in rows(VersionedTable(spark, table.path).scan())] == [1, 2, 3]


def test_checkpoints_of_the_log(spark, table):
    table.create(frame(spark, [(0, 0.0)]))
    for i in range(1, 13):
        table.append(frame(spark, [(i, 0.0)]))
    fresh = VersionedTable(spark, table.path)
    assert fresh.scan().count() == 13 and fresh.scan(4).count() == 5


def test_partitions_prune_files_and_keep_odd_values(spark, table):
    odd = ["a b", "c=d/e", "", None, "ü%41"]
    table.create(frame(spark, [(i, p) for i, p in enumerate(odd)], "id long, p string"), ["p"])
    assert sorted(map(repr, (r.p for r in table.scan().collect()))) == sorted(map(repr, odd))
    for i, p in enumerate(odd):
        found = table.scan(partitions={"p": [p]})
        assert [r.id for r in found.collect()] == [i]
    assert len(table.scan(partitions={"p": ["a b"]}).inputFiles()) == 1


def test_upsert_replaces_and_keeps_duplicates_of_the_batch(spark, table):
    merge.write_upsert(table, frame(spark, [(1, 1.0), (1, 1.5), (2, 2.0), (3, 3.0)]), "id")  # a first write is not deduplicated
    assert table.scan().count() == 4
    merge.write_upsert(table, frame(spark, [(2, 20.0), (4, 4.0), (4, 4.5)]), "id")
    assert rows(table.scan()) == [(1, 1.0), (1, 1.5), (2, 20.0), (3, 3.0), (4, 4.0), (4, 4.5)]
    merge.write_upsert(table, frame(spark, [(4, 9.0), (4, 8.0)]), "id", dedup="last", order_by="v")
    assert (4, 9.0) in rows(table.scan()) and table.scan().filter("id = 4").count() == 1


def test_null_keys_never_match(spark, table):
    merge.write_upsert(table, frame(spark, [(None, 1.0), (1, 1.0)]), "id")
    merge.write_upsert(table, frame(spark, [(None, 2.0), (1, 2.0)]), "id")
    assert rows(table.scan()) == [(1, 2.0), (None, 1.0), (None, 2.0)]


def test_partitioned_upsert_leaves_other_files_alone_and_moved_keys_behind(spark, table):
    schema = "id long, year int, v double"
    base = [(1, 2020, 1.0), (2, 2021, 2.0), (3, 2021, 3.0), (4, 2022, 4.0)]
    on = ["id", "year"]
    merge.write_upsert(table, frame(spark, base, schema), on, ["year"])
    before = {f for f in table.files() if "2021" not in f}
    merge.write_upsert(table, frame(spark, [(2, 2021, 20.0), (1, 2021, 10.0)], schema), on, ["year"])
    assert before <= set(table.files())
    assert rows(table.scan()) == sorted([(1, 2020, 1.0), (1, 2021, 10.0), (2, 2021, 20.0), (3, 2021, 3.0), (4, 2022, 4.0)], key=repr)


def test_upsert_may_add_columns(spark, table):
    merge.write_upsert(table, frame(spark, [(1, 1.0), (2, 2.0)]), "id")
    merge.write_upsert(table, frame(spark, [(2, 5.0, "n")], "id long, v double, note string"), "id")
    assert rows(table.scan()) == [(1, 1.0, None), (2, 5.0, "n")]


def test_scd2_closes_and_opens_in_one_commit(spark, table):
    people = "id long, name string"
    merge.write_scd2(table, frame(spark, [(1, "a"), (2, "b")], people), "id", now=T1)
    merge.write_scd2(table, frame(spark, [(1, "c"), (3, "d")], people), "id", now=T2)
    got = {(r.id, r.name, r.is_current, r.valid_to is None) for r in table.scan().collect()}
    assert got == {(1, "a", False, False), (1, "c", True, True), (2, "b", True, True), (3, "d", True, True)}
    assert table.version() == 1
    merge.write_scd2(table, frame(spark, [(1, "c")], people), "id", now=T2)  # the same batch again: closed, not added twice
    assert table.scan().filter("id = 1").count() == 2


def test_scd2_with_partitions_closes_only_there(spark, table):
    people = "id long, region string, name string"
    merge.write_scd2(table, frame(spark, [(1, "EU", "a"), (1, "US", "b")], people), "id", ["region"], T1)
    us = {f for f in table.files() if "=US" in f}
    merge.write_scd2(table, frame(spark, [(1, "EU", "c")], people), "id", ["region"], T2)
    assert us <= set(table.files())
    assert {(r.region, r.name, r.is_current) for r in table.scan().collect()} == {("EU", "a", False), ("EU", "c", True), ("US", "b", True)}


def test_scd4_archives_what_is_replaced(spark, table, tmp_path):
    history = VersionedTable(spark, f"{tmp_path}/h")
    people = "id long, name string, n int"
    merge.write_scd4(table, history, frame(spark, [(1, "a", 1), (1, "b", 2), (2, "x", 1)], people), "id", now=T1, order_by="n")
    assert not history.exists() and rows(table.scan()) == [(1, "b", 2), (2, "x", 1)]
    merge.write_scd4(table, history, frame(spark, [(1, "c", 3), (9, "z", 1)], people), "id", now=T2, order_by="n")
    merge.write_scd4(table, history, frame(spark, [(1, "d", 4)], people), "id", now=T3, order_by="n")
    assert rows(history.scan().select("id", "name")) == [(1, "b"), (1, "c")]
    assert rows(table.scan()) == [(1, "d", 4), (2, "x", 1), (9, "z", 1)]


def test_pure_merges_agree_with_the_commits(spark, table):
    a, b = frame(spark, [(1, 1.0), (2, 2.0)]), frame(spark, [(2, 3.0), (5, 5.0)])
    merge.write_upsert(table, a, "id")
    merge.write_upsert(table, b, "id")
    assert rows(merge.upsert(a, b, ["id"])) == rows(table.scan())
    main, archived = merge.scd4(a, b, ["id"], T1)
    assert rows(main) == rows(table.scan()) and rows(archived.select("id", "v")) == [(2, 2.0)]
    new = merge.scd2(merge.opened(a, T1), b, ["id"], T2)
    assert rows(new.groupBy("is_current").count()) == [(False, 1), (True, 3)]


def test_literals_and_predicates(spark):
    assert merge.sql_literal("o'b", T.StringType()) == "'o''b'"
    assert merge.sql_literal(3, T.IntegerType()) == "CAST(3 AS INT)" and merge.sql_literal(True, T.BooleanType()) == "true"
    assert merge.sql_literal(date(2024, 1, 2), T.DateType()) == "DATE '2024-01-02'"
    df = frame(spark, [(2021, "US"), (2020, "EU"), (2021, "EU")], "year int, region string")
    p = merge.partition_predicate(df, ["year", "region"])
    years, regions = p.split(" AND ")
    assert years == "year IN (CAST(2020 AS INT), CAST(2021 AS INT))" and regions == "region IN ('EU', 'US')"
    assert df.filter(p).count() == 3
    assert merge.partition_predicate(frame(spark, [("EU",), (None,)], "r string"), ["r"]) is None
    assert merge.partition_predicate(frame(spark, [(1.5,)], "r double"), ["r"]) is None


def test_change_feed(spark, table):
    merge.write_upsert(table, frame(spark, [(1, 1.0), (2, 2.0)]), "id")
    merge.write_upsert(table, frame(spark, [(2, 3.0)]), "id")
    table.append(frame(spark, [(7, 7.0)]))
    table.delete_all()
    got = {(r._change_type, r._commit_version, r.id) for r in table.changes(0).collect()}
    assert {x for x in got if x[0] != "delete"} == {("insert", 0, 1), ("insert", 0, 2), ("update_postimage", 1, 2), ("insert", 2, 7)}
    assert {x[2] for x in got if x[0] == "delete"} == {1, 2, 7}
    assert table.scan().count() == 0
    assert table.changes(1, 1).count() == 1


def test_maintenance_keeps_the_rows(spark, table):
    for i in range(4):
        merge.write_append(table, frame(spark, [(i, float(i % 2))]))
    before = rows(table.scan())
    assert len(table.files()) >= 4
    compact(table)
    assert len(table.files()) == 1 and rows(table.scan()) == before
    assert compact(table) is None
    zorder(table, ["id", "v"])
    assert rows(table.scan()) == before
    assert table.changes(4).count() == 0  # maintenance is no change
    assert vacuum(table, 168) == 0 and vacuum(table, 0) > 0
    assert rows(table.scan()) == before
    maintain(table.path, z_order_by="id", vacuum=False, spark=spark)
    with pytest.raises(TableMissing):
        maintain(table.path + "-none", spark=spark)


def test_zorder_clusters_both_columns(spark, table):
    table.create(spark.range(4000).select((F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"), F.lit("x").alias("c")))
    zorder(table, ["a", "b"], file_bytes=500)
    spans = table.scan().groupBy(F.input_file_name()).agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b"))
    assert len(table.files()) > 3 and spans.agg(F.avg("a") + F.avg("b")).first()[0] < 126


def test_zorder_key_is_small_enough_for_the_jvm_to_compile(spark):
    ids = spark.range(20_000).select(*[(F.col("id") * k % 20_000).alias(c) for c, k in zip("abcd", (1, 7, 11, 13))])
    debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
    for columns in (["a", "b"], ["a", "b", "c", "d"]):
        stages = debug.codegenStringSeq(with_zorder(ids, columns)._jdf.queryExecution().executedPlan())
        assert stages.size() and all(0 < stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))


def test_zorder_places_count_the_bounds_at_or_below(spark):
    values = [None, -math.inf, -1.0, -0.0, 0.5, 3.0, 63.5, 254.0, 255.0, 1e9, math.inf, math.nan]
    bounds = {f"p{n}": [float(i) for i in range(n)] for n in (0, 1, 2, 7, 100, 255)}
    df = bucketed(frame(spark, [(i, v) for i, v in enumerate(values)]), {p: (F.col("v"), b) for p, b in bounds.items()})
    assert df.columns == ["id", "v", *bounds]
    for r in df.collect():
        v = values[r.id]
        for p, b in bounds.items():
            assert r[p] == (0 if v is None else len(b) if math.isnan(v) else bisect_right(b, v)), (p, v)


def test_appends_that_each_add_a_column_keep_both(spark, tmp_path):
    path = f"file://{tmp_path}/both"
    VersionedTable(spark, path).create(spark.range(1).selectExpr("id"))
    a, b = VersionedTable(spark, path), VersionedTable(spark, path)
    a.state(), b.state()
    stale, b.state = b.state, lambda *x: stale_once(*x)
    old = stale()

    def stale_once(*x):
        b.state = stale
        return old

    a.append(spark.range(1, 2).selectExpr("id", "'a' AS left"))
    b.append(spark.range(2, 3).selectExpr("id", "'b' AS right"))
    got = VersionedTable(spark, path).scan()
    assert sorted(got.columns) == ["id", "left", "right"]
    assert sorted((r.id, r.left, r.right) for r in got.collect()) == [(0, None, None), (1, "a", None), (2, None, "b")]


def test_a_stream_finds_its_last_batch_in_the_log(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/stream")
    assert t.last_batch("s") == -1
    t.create(spark.range(1).selectExpr("id"))
    t.stream = ["s", 4]
    t.append(spark.range(1).selectExpr("id"))
    VersionedTable(spark, t.path).append(spark.range(1).selectExpr("id"))
    assert t.last_batch("s") == 4 and t.last_batch("other") == -1

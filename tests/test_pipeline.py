import json
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alluvia import Batch, SchemaError, SchemaViolation, Source, VersionedTable, from_frame, from_query, incremental, make_lazy, schema
from alluvia.sources.core import list_files, scan_files
from alluvia.sources.state import Ledger, code_hash
from alluvia.streaming import sinks


def put(spark, path, data, ddl="id long, value double"):
    spark.createDataFrame(data, ddl).coalesce(1).write.mode("overwrite").parquet(str(path))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_directory_runs_only_over_new_files(spark, tmp_path):
    put(spark, tmp_path / "in/a", [(1, 1.0), (2, 2.0)])

    @incremental(source=f"{tmp_path}/in", target=f"{tmp_path}/out")
    def load(df):
        "Loads."
        return df.filter("value > 0")

    assert load.__name__ == "load" and load.__doc__ == "Loads."
    labels = load.run(dry_run=True)
    assert len(labels) == 1 and not VersionedTable(spark, load.target).exists()
    assert load.run() == labels and load.run() == []
    put(spark, tmp_path / "in/b", [(3, 3.0)])
    assert len(load.run()) == 1
    out = VersionedTable(spark, load.target).scan()
    assert ids(out) == [1, 2, 3] and {"_source_file", "_ingested_at"} <= set(out.columns)
    assert out.filter("id = 3").first()._source_file.startswith(f"{tmp_path}/in/b/")
    assert json.loads(load.status().first().cursor_json) == sorted(load.ledger.cursors()[0])
    load.reset()
    assert len(load.run()) == 2 and VersionedTable(spark, load.target).scan().count() == 6


def test_a_crash_before_the_ledger_repeats_the_batch(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "in/a", [(1, 1.0)])
    load = incremental(source=f"{tmp_path}/in", target=f"{tmp_path}/out", merge_on="id")(lambda df: df.select("id", "value"))
    monkeypatch.setattr(Ledger, "save_cursors", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        load.run()
    monkeypatch.undo()
    assert len(load.run()) == 1 and ids(VersionedTable(spark, load.target).scan()) == [1]


@pytest.mark.parametrize("fmt", ["csv", "ndjson"])
def test_text_formats(spark, tmp_path, fmt):
    (tmp_path / "in").mkdir()
    text = {"csv": "id;value;note\n1;1.5;NA\n2;;x\n", "ndjson": '{"value": 1.5, "id": 1}\n{"value": null, "id": 2, "note": "x"}\n'}[fmt]
    (tmp_path / f"in/a b+c.{fmt}").write_text(text)
    (tmp_path / "in/_hidden.csv").write_text("no")
    options = {"separator": ";", "null_values": "NA", "schema_overrides": {"id": "string"}} if fmt == "csv" else {}
    load = incremental(source=f"{tmp_path}/in", target=f"{tmp_path}/out", file_format=fmt, reader_kwargs=options)(lambda df: df)
    assert load.run() == [f"{tmp_path}/in/a b+c.{fmt}"]
    out = VersionedTable(spark, load.target).scan()
    assert out.columns[:3] == (["id", "value", "note"] if fmt == "csv" else ["value", "id", "note"])
    assert sorted((str(r.id), r.value, r._source_file) for r in out.collect())[0] == ("1", 1.5, f"{tmp_path}/in/a b+c.{fmt}")


def test_files_must_agree_unless_told_otherwise(spark, tmp_path):
    put(spark, tmp_path / "in/a", [(1, 1.0)])
    put(spark, tmp_path / "in/b", [(2, 2.0, "x")], "id long, value double, more string")
    files = list_files(spark, f"{tmp_path}/in", (".parquet",))
    with pytest.raises(ValueError, match="different schemas"):
        scan_files(spark, files, "parquet")
    assert scan_files(spark, files, "parquet", concat_options={"how": "diagonal"}).count() == 2
    assert list_files(spark, f"{tmp_path}/none", (".parquet",)) == []


def test_many_files_must_agree_as_well(spark, tmp_path):
    for i in range(70):
        put(spark, tmp_path / f"in/{i:02d}", [(i, 1.0)] if i != 66 else [(i, 1.0, "x")], "id long, value double" + (", more string" if i == 66 else ""))
    files = list_files(spark, f"{tmp_path}/in", (".parquet",))
    with pytest.raises(ValueError, match="different schemas"):
        scan_files(spark, files, "parquet")
    got = scan_files(spark, files, "parquet", concat_options={"how": "diagonal"})
    assert got.count() == 70 and got.filter("more = 'x'").count() == 1 and set(got.columns) == {"id", "value", "more", "_source_file", "_ingested_at"}


def test_query_and_frame_sources(spark, tmp_path):
    data = [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")]

    def fetch(since):
        df = spark.createDataFrame(data, "id long, ts string")
        df = df.filter(F.col("ts") > since) if since else df
        return df if df.count() else None

    load = incremental(source=from_query(fetch, "ts"), target=f"{tmp_path}/q", merge_on="id")(lambda df: df)
    assert load.run() == ["2024-01-03"] and load.run() == []
    data.append((4, "2024-01-04"))
    assert load.run() == ["2024-01-04"] and ids(VersionedTable(spark, load.target).scan()) == [1, 2, 3, 4]
    empty = from_query(lambda since: spark.createDataFrame([(1, None)], "id long, ts string"), "ts")
    assert empty.poll(None) is None
    always = incremental(source=from_frame(lambda: spark.range(2)), target=f"{tmp_path}/f")(lambda df: df)
    assert always.run() == ["None"] and always.run() == ["None"]
    assert VersionedTable(spark, always.target).scan().count() == 4


def test_fan_in_leaves_out_idle_sources(spark, tmp_path):
    put(spark, tmp_path / "a/x", [(1, 1.0)])
    put(spark, tmp_path / "b/x", [(2, 2.0)])
    seen = []

    class Once:
        def poll(self, since):
            return None if since else Batch(spark.createDataFrame([(9, 9.0)], "id long, value double"), "done")

    assert isinstance(Once(), Source)

    @incremental(source=[f"{tmp_path}/a", f"{tmp_path}/b", Once()], target=f"{tmp_path}/out")
    def both(*frames):
        seen.append(len(frames))
        out = frames[0].select("id", "value")
        for f in frames[1:]:
            out = out.unionByName(f.select("id", "value"))
        return out

    assert len(both.run()) == 3
    put(spark, tmp_path / "b/y", [(3, 3.0)])
    both.run()
    assert seen == [3, 1] and ids(VersionedTable(spark, both.target).scan()) == [1, 2, 3, 9]
    assert both(spark.range(1).withColumn("value", F.lit(1.0))).count() == 1


def test_table_source_reads_the_change_feed(spark, tmp_path):
    up = incremental(source=f"{tmp_path}/in", target=f"{tmp_path}/up", merge_on="id")(lambda df: df.select("id", "value"))
    down = incremental(source=f"{tmp_path}/up", target=f"{tmp_path}/down", merge_on="id", file_format="table")(lambda df: df.withColumn("twice", F.col("value") * 2))
    put(spark, tmp_path / "in/a", [(1, 1.0), (2, 2.0)])
    up.run()
    assert down.run() == ["v0"] and down.run() == []
    put(spark, tmp_path / "in/b", [(2, 5.0)])
    up.run()
    put(spark, tmp_path / "in/c", [(2, 6.0), (3, 3.0)])
    up.run()
    assert down.run() == ["v2"]
    assert {(r.id, r.twice) for r in VersionedTable(spark, down.target).scan().collect()} == {(1, 2.0), (2, 12.0), (3, 6.0)}
    with pytest.raises(FileNotFoundError):
        incremental(source=f"{tmp_path}/none", target=f"{tmp_path}/z", file_format="delta")(lambda df: df).run()


def test_arguments_are_checked_when_decorated(spark, tmp_path):
    for wrong in ({"merge_on": []}, {"scd_type": 4, "merge_on": "id"}, {"scd_type": 2}, {"scd_type": 3}, {"file_format": "xml"}):
        with pytest.raises(ValueError):
            incremental(source="s", target="t", **wrong)(lambda df: df)
    with pytest.raises(TypeError):
        incremental(source=object(), target=f"{tmp_path}/t")(lambda df: df).run()


def test_scd_types_through_run(spark, tmp_path):
    clock = iter(datetime(2024, 1, d, tzinfo=timezone.utc) for d in range(1, 20))
    for kind in (2, 4):
        put(spark, tmp_path / f"in{kind}/a", [(1, 1.0), (2, 2.0)])
        load = incremental(source=f"{tmp_path}/in{kind}", target=f"{tmp_path}/o{kind}", merge_on="id", scd_type=kind, history_target=f"{tmp_path}/h", now=lambda: next(clock))(lambda df: df.select("id", "value"))
        load.run()
        put(spark, tmp_path / f"in{kind}/b", [(1, 9.0)])
        load.run()
        assert VersionedTable(spark, load.target).scan().count() == (3 if kind == 2 else 2)
    assert ids(VersionedTable(spark, f"{tmp_path}/h").scan()) == [1]


def test_changed_code_is_noticed(spark, tmp_path):
    put(spark, tmp_path / "in/a", [(1, 1.0)])
    make = lambda fn, fail: incremental(source=f"{tmp_path}/in", target=f"{tmp_path}/out", fail_on_version_mismatch=fail)(fn)
    one, two = make(lambda df: df.select("id"), False), make(lambda df: df.select("id").filter("id > 0"), True)
    one.run()
    assert one.ledger.code() == one.pipeline_hash != two.pipeline_hash
    put(spark, tmp_path / "in/b", [(2, 1.0)])
    with pytest.raises(RuntimeError, match="changed"):
        two.run()
    assert code_hash(lambda x: x + 1) == code_hash(lambda x: x + 1) != code_hash(lambda x: x + 2)


def test_maintenance_every_few_runs(spark, tmp_path):
    load = incremental(source=f"{tmp_path}/in", target=f"{tmp_path}/out", compact_every=3)(lambda df: df.select("id"))
    for k in range(3):
        put(spark, tmp_path / f"in/{k}", [(k, 0.0)])
        load.run()
        assert load.ledger.runs() == k + 1
    table = VersionedTable(spark, load.target)
    assert len(table.files()) == 1 and ids(table.scan()) == [0, 1, 2]
    load.maintain(z_order_by="id", vacuum=True, retention_hours=0)
    assert load.run() == []  # the ledger below the table outlives the vacuum


def test_contract_modes(spark, tmp_path):
    fn = lambda df: df.withColumn("ok", F.lit(1))
    df = spark.createDataFrame([(1, "x", "f")], "id int, extra string, _source_file string")
    with pytest.raises(SchemaError) as e:
        schema({"id": "int", "value": "double"})(fn)(df)
    assert e.value.violations == [SchemaViolation("value", "missing", "double")] and e.value.violations[0].to_dict()["issue"] == "missing"
    with pytest.raises(SchemaError, match="extra"):
        schema({"id": "int"}, on_extra="raise")(fn)(df)
    assert schema({"id": "int"}, on_extra="drop")(fn)(df).columns == ["id", "_source_file", "ok"]
    assert "extra" in schema({"id": "int"})(fn)(df).columns
    with pytest.raises(SchemaError, match="bigint"):
        schema({"id": "bigint"})(fn)(df)
    for evolution in ("cast", "merge"):
        assert dict(schema({"id": "bigint"}, evolution=evolution)(fn)(df).dtypes)["id"] == "bigint"
    with pytest.raises(TypeError):
        schema({"id": "int"})(fn)(df, df)
    with pytest.raises(ValueError):
        schema({}, on_missing="ignore")


def test_a_skipped_batch_is_quarantined_and_not_polled_again(spark, tmp_path):
    put(spark, tmp_path / "in/a", [(1, 1.0)])
    fn = schema({"id": "bigint", "name": "string"}, on_missing="quarantine", quarantine=f"{tmp_path}/bad")(lambda df: df)
    load = incremental(source=f"{tmp_path}/in", target=f"{tmp_path}/out")(fn)
    assert len(load.run()) == 1 and load.run() == [] and not VersionedTable(spark, load.target).exists()
    bad = VersionedTable(spark, f"{tmp_path}/bad").scan().first()
    assert json.loads(bad._violations)[0]["column"] == "name" and bad._quarantined_at and bad.id == 1


def batches(sizes, schema_):
    start = 0
    for n in sizes:
        yield pa.record_batch([pa.array(range(start, start + n), pa.int64()), pa.array(["x"] * n)], schema=schema_)
        start += n


def test_arrow_batches(spark):
    schema_ = pa.schema({"id": pa.int64(), "name": pa.string()})

    def factory():
        start, out = 0, []
        s = pa.schema({"id": pa.int64(), "name": pa.string()})
        for n in (2, 0, 3, 3):
            out.append(pa.record_batch([pa.array(range(start, start + n), pa.int64()), pa.array(["x"] * n, pa.string())], schema=s))
            start += n
        return pa.RecordBatchReader.from_batches(s, out)

    for df in (make_lazy(pa.RecordBatchReader.from_batches(schema_, batches([2, 0, 3, 3], schema_)), spark), make_lazy(factory, spark)):
        assert df.columns == ["id", "name"] and ids(df) == list(range(8))
        assert df.limit(5).count() == 5 and df.select("name").distinct().count() == 1
        assert df.filter("id >= 6").count() == 2
    assert make_lazy(pa.RecordBatchReader.from_batches(schema_, []), spark).count() == 0


def test_streams_write_the_same_tables(spark, tmp_path):
    put(spark, tmp_path / "in/a", [(1, 1.0), (2, 2.0)])
    run = lambda: sinks.write_batches(sinks.files(spark, f"{tmp_path}/in/*", "id long, value double"), f"{tmp_path}/out", f"{tmp_path}/ck", merge_on="id").awaitTermination(60)
    run()
    put(spark, tmp_path / "in/b", [(2, 5.0), (3, 3.0)])
    run()
    run()
    assert {tuple(r) for r in VersionedTable(spark, f"{tmp_path}/out").scan().collect()} == {(1, 1.0), (2, 5.0), (3, 3.0)}

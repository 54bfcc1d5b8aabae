"""Every query of the driver, by name, with DuckDB SQL that gives the same rows.

Queries that write do so below the shared scratch folder. Merges split ``orders`` into what a table holds and what a batch brings.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alluvia.functions.lists import AGGREGATES, COMPARISONS, agg_of_range, aggregate_elementwise, ieee_div, list_ext, list_join_exploded, operate_scalar_on_list
from alluvia.functions.parsing import replace_values, rolling_mean, strftime, to_date, zfill
from alluvia.functions.signal import apply_fft, fft_freqs, interpolate_columns
from alluvia.operators import merge
from alluvia.operators.contract import schema
from alluvia.operators.maintenance import compact, vacuum, zorder
from alluvia.plans.pipeline import incremental
from alluvia.sources.arrow import make_lazy
from alluvia.sources.core import from_query
from alluvia.sources.table import VersionedTable, union_by_name
from alluvia.storage import Scratch
from alluvia.streaming import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in range(1, 10)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_table(spark: SparkSession, name: str) -> VersionedTable:
    return VersionedTable(spark, Scratch(spark, name).path("table"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a table holds (two of three orders), and a batch (all others and half of these, dearer): together every order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 = 0 OR o_orderkey % 2 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") + 1000, 2))


BASE = "base AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)"
NEW = "batch AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice + 1000, 2) AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0)"


# ingestion


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders GROUP BY o_orderpriority")
def incremental_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files in turn, each ingested once; then revenue by priority."""
    scratch = Scratch(spark, "ingest")
    o = table(spark, sf_dir, "orders")
    load = incremental(source=scratch.path("in"), target=scratch.path("orders"))(lambda df: df.select("o_orderpriority", "o_totalprice"))
    for part in (0, 1):
        o.filter(F.col("o_orderkey") % 2 == part).write.parquet(scratch.path(f"in/{part}"))
        load.run()
    if load.run():
        raise AssertionError("a run without new files found some")
    t = VersionedTable(spark, load.target).scan()
    return t.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders"))


flagship = incremental_two_runs


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    o.write.option("header", True).option("sep", ";").csv(scratch.path("in"))
    load = incremental(source=scratch.path("in"), target=scratch.path("out"), file_format="csv", reader_kwargs={"separator": ";", "schema": o.schema})(lambda df: df.select(*o.columns))
    load.run()
    return VersionedTable(spark, load.target).scan()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ndjson_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "ndjson")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.json(scratch.path("raw"))
    # the source looks for .ndjson files
    spark.read.text(scratch.path("raw")).repartition(1).write.text(scratch.path("text"))
    fs = Scratch(spark, "x").fs
    fs.mkdirs(scratch.path("in"))
    for p, _, _ in fs.list(scratch.path("text")):
        if p.endswith(".txt"):
            fs.of(p).rename(fs.path(p), fs.path(scratch.path("in") + "/" + p.rsplit("/", 1)[-1][:-4] + ".ndjson"))
    load = incremental(source=scratch.path("in"), target=scratch.path("out"), file_format="ndjson", reader_kwargs={"schema": "n_nationkey int, n_name string, n_regionkey int"})(lambda df: df.drop("_source_file", "_ingested_at"))
    load.run()
    return VersionedTable(spark, load.target).scan()


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def query_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom source in two polls, with the greatest id as its cursor."""
    scratch, e = Scratch(spark, "query"), table(spark, sf_dir, "events")
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]

    def fetch(since):
        return e.filter(F.col("event_id") <= middle) if since is None else e.filter(F.col("event_id") > since)

    load = incremental(source=from_query(fetch, "event_id"), target=scratch.path("out"))(lambda df: df.select("event_type", "event_id"))
    load.run(), load.run()
    return VersionedTable(spark, load.target).scan().groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("SELECT kind, count(*) AS n, round(sum(amount), 2) AS amount FROM (SELECT 'order' AS kind, o_totalprice AS amount FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem) GROUP BY kind")
def fan_in_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "fan")
    table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount")).write.parquet(scratch.path("a"))
    table(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_extendedprice").alias("amount")).write.parquet(scratch.path("b"))
    load = incremental(source=[scratch.path("a"), scratch.path("b")], target=scratch.path("out"))(lambda a, b: a.select("kind", "amount").unionByName(b.select("kind", "amount")))
    load.run()
    return VersionedTable(spark, load.target).scan().groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(f"WITH {BASE}, {NEW} SELECT o_orderkey, o_totalprice FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT o_orderkey, o_totalprice FROM batch")
def change_feed_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table fed by another's change feed over an upsert."""
    scratch = Scratch(spark, "feed")
    up = VersionedTable(spark, scratch.path("up"))
    down = incremental(source=up.path, target=scratch.path("down"), merge_on="o_orderkey", file_format="table")(lambda df: df.select("o_orderkey", "o_totalprice"))
    for batch in halves(spark, sf_dir):
        merge.write_upsert(up, batch, "o_orderkey")
        down.run()
    return VersionedTable(spark, down.target).scan()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def arrow_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record batches through the Python data source; the reader is made where it is read, from rows that the driver holds (one table's few columns)."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").toArrow()
    reader = pa.RecordBatchReader.from_batches(rows.schema, rows.to_batches(max_chunksize=500))
    return make_lazy(reader, spark)


@query(f"WITH {BASE}, {NEW} SELECT o_orderkey, o_orderstatus, o_totalprice FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM batch")
def streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stream")
    for n, batch in enumerate(halves(spark, sf_dir)):
        batch.write.parquet(scratch.path(f"in/{n}"))
        q = sinks.write_batches(sinks.files(spark, scratch.path("in/*"), batch.schema), scratch.path("out"), scratch.path("ck"), merge_on="o_orderkey")
        q.awaitTermination()
    return VersionedTable(spark, scratch.path("out")).scan()


# merges


def merged(spark: SparkSession, sf_dir: str, on: list[str], parts: list[str], change=lambda df: df, **options) -> DataFrame:
    base, batch = halves(spark, sf_dir)
    t = new_table(spark, "upsert")
    merge.write_upsert(t, base, on, parts)
    merge.write_upsert(t, change(batch), on, parts, **options)
    return t.scan()


@query(ORACLE_SQL["streaming_upsert"])
def upsert_scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir, ["o_orderkey"], [])


@query(ORACLE_SQL["streaming_upsert"])
def upsert_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir, ["o_orderkey", "o_orderstatus"], ["o_orderstatus"])


@query(f"WITH {BASE}, {NEW}, moved AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice FROM batch) SELECT * FROM base UNION ALL SELECT * FROM moved")
def upsert_partition_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that move to another partition leave their old rows behind."""
    return merged(spark, sf_dir, ["o_orderkey", "o_orderstatus"], ["o_orderstatus"], lambda b: b.withColumn("o_orderstatus", F.lit("X")))


@query(f"WITH {BASE}, {NEW}, b AS (SELECT nullif(o_orderkey % 7, 0) * 0 + o_orderkey AS k, o_totalprice FROM base), n AS (SELECT nullif(o_orderkey % 7, 0) * 0 + o_orderkey AS k, o_totalprice FROM batch) SELECT k, o_totalprice FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = b.k) UNION ALL SELECT k, o_totalprice FROM n")
def upsert_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = (x.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("k"), "o_totalprice") for x in halves(spark, sf_dir))
    t = new_table(spark, "nulls")
    merge.write_upsert(t, base, "k")
    merge.write_upsert(t, batch, "k")
    return t.scan()


@query(f"WITH {BASE}, {NEW} SELECT o_orderkey, o_orderstatus, o_totalprice FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT * FROM batch UNION ALL SELECT * FROM batch")
def upsert_dup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir, ["o_orderkey"], [], lambda b: b.unionByName(b))


@query(f"WITH {BASE}, {NEW}, b AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice + 5, 2) AS o_totalprice FROM batch) SELECT o_orderkey, o_orderstatus, o_totalprice FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT * FROM b")
def upsert_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir, ["o_orderkey"], [], lambda b: b.unionByName(b.withColumn("o_totalprice", F.round(F.col("o_totalprice") + 5, 2))), dedup="last", order_by="o_totalprice")


@query(f"WITH {BASE}, {NEW} SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS note FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT o_orderkey, o_totalprice, 'new' FROM batch")
def upsert_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = halves(spark, sf_dir)
    t = new_table(spark, "evolve")
    merge.write_upsert(t, base.select("o_orderkey", "o_totalprice"), "o_orderkey")
    merge.write_upsert(t, batch.select("o_orderkey", "o_totalprice", F.lit("new").alias("note")), "o_orderkey")
    return t.scan()


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    t = new_table(spark, "append")
    for part in range(3):
        merge.write_append(t, o.filter(F.col("o_orderkey") % 3 == part), ["o_orderpriority"])
    return t.scan()


def versions(spark: SparkSession, sf_dir: str, parts: list[str]) -> VersionedTable:
    t = new_table(spark, "scd2")
    for day, batch in zip(DAY, halves(spark, sf_dir)):
        merge.write_scd2(t, batch, "o_orderkey", parts, day)
    return t


SCD2 = f"""{BASE}, {NEW}, v AS (
    SELECT b.*, '2024-01-01' AS valid_from, CASE WHEN n.o_orderkey IS NOT NULL THEN '2024-01-02' END AS valid_to, n.o_orderkey IS NULL AS is_current
    FROM base AS b LEFT JOIN batch AS n ON b.o_orderkey = n.o_orderkey
    UNION ALL SELECT *, '2024-01-02', NULL, true FROM batch)"""


def dated(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")})


@query(f"WITH {SCD2} SELECT * FROM v")
def scd2_close_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(versions(spark, sf_dir, []).scan())


@query(f"WITH {SCD2} SELECT * FROM v")
def scd2_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(versions(spark, sf_dir, ["o_orderstatus"]).scan())


@query(f"WITH {SCD2} SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM v WHERE is_current GROUP BY o_orderstatus")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir, []).scan().filter("is_current").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {SCD2} SELECT o_orderkey, o_totalprice FROM v WHERE valid_from <= '2024-01-01' AND (valid_to IS NULL OR valid_to > '2024-01-01')")
def scd2_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(DAY[0]).cast("timestamp")
    return versions(spark, sf_dir, []).scan().filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("o_orderkey", "o_totalprice")


def scd4(spark: SparkSession, sf_dir: str) -> tuple[VersionedTable, VersionedTable]:
    t, h = new_table(spark, "scd4"), new_table(spark, "scd4h")
    for day, batch in zip(DAY, halves(spark, sf_dir)):
        merge.write_scd4(t, h, batch.unionByName(batch.withColumn("o_totalprice", F.lit(0.0))), "o_orderkey", None, day, "o_totalprice")
    return t, h


@query(ORACLE_SQL["streaming_upsert"])
def scd4_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd4(spark, sf_dir)[0].scan()


@query(f"WITH {BASE}, {NEW} SELECT o_orderkey, o_orderstatus, o_totalprice, '2024-01-02' AS superseded_at FROM base WHERE o_orderkey IN (SELECT o_orderkey FROM batch)")
def scd4_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd4(spark, sf_dir)[1].scan().withColumn("superseded_at", F.date_format("superseded_at", "yyyy-MM-dd"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def snapshot_dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return merge.keep_last(e, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "value")


@query(f"WITH {BASE}, {NEW} SELECT 'insert' AS _change_type, 0 AS _commit_version, count(*) AS n FROM base UNION ALL SELECT 'update_postimage', 1, count(*) FROM batch")
def change_feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = new_table(spark, "changes")
    for batch in halves(spark, sf_dir):
        merge.write_upsert(t, batch, "o_orderkey")
    return t.changes(0).groupBy("_change_type", F.col("_commit_version").cast("int").alias("_commit_version")).agg(F.count("*").alias("n"))


@query(f"WITH {BASE} SELECT o_orderkey, o_totalprice FROM base")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = new_table(spark, "travel")
    for batch in halves(spark, sf_dir):
        merge.write_upsert(t, batch, "o_orderkey")
    return t.scan(0).select("o_orderkey", "o_totalprice")


# contracts and maintenance


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem")
def schema_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = schema({"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "bigint"}, on_extra="drop", evolution="cast")(lambda df: df.select("l_orderkey", "l_linenumber", "l_quantity"))
    return fn(table(spark, sf_dir, "lineitem"))


@query("SELECT n_nationkey, n_name FROM nation")
def schema_drop_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema({"n_nationkey": "int", "n_name": "string"}, on_extra="drop")(lambda df: df)(table(spark, sf_dir, "nation"))


@query("""SELECT r_regionkey, r_name, '[{"column": "r_zone", "issue": "missing", "expected": "string", "actual": null}]' AS _violations FROM region""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "quarantine").path("bad")
    schema({"r_zone": "string"}, on_missing="quarantine", quarantine=store)(lambda df: df)(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return VersionedTable(spark, store).scan().drop("_quarantined_at")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def compact_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), new_table(spark, "compact")
    for part in range(3):
        merge.write_append(t, c.filter(F.col("c_custkey") % 3 == part), ["c_mktsegment"])
    compact(t)
    vacuum(t, 0)
    return t.scan()


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem")
def zorder_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = new_table(spark, "zorder")
    merge.write_append(t, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"))
    zorder(t, ["l_partkey", "l_suppkey"], file_bytes=1 << 20)
    return t.scan()


# relational operators


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity >= 10 AND NOT (l_returnflag = 'R' OR l_linestatus <> 'F')")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keep = (F.col("l_shipdate") < "1996-01-01") & (F.col("l_quantity") >= 10) & ~((F.col("l_returnflag") == "R") | (F.col("l_linestatus") != "F"))
    return li.filter(keep).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5, 7)")
def isin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter(F.col("s_nationkey").isin(1, 3, 5, 7)).select("s_suppkey", "s_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def between_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, strftime(o_orderdate, '%b') AS name, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def group_avg_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.year(d).alias("y"), F.month(d).alias("m"), strftime(d, "%b").alias("name")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT l_returnflag, sum(l_quantity) AS total, round(avg(l_extendedprice), 4) AS mean, upper(l_returnflag) AS label, round(max(l_extendedprice), 0) AS top FROM lineitem GROUP BY l_returnflag")
def group_sum_mean_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.first(F.upper("l_returnflag")).alias("label"), F.round(F.max("l_extendedprice"), 0).alias("top"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def count_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 1")


DAILY = "d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1)"


@query(f"WITH {DAILY} SELECT day, CASE WHEN count(*) OVER w = 7 THEN round(avg(v) OVER w, 2) END AS mean FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def rolling_mean_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return daily.select("day", F.round(rolling_mean("v", 7, "day"), 2).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN count(*) OVER w = 3 THEN round(avg(l_quantity) OVER w, 6) END AS mean FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_mean_over_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = rolling_mean("l_quantity", 3, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(mean, 6).alias("mean"))


@query("WITH t AS (SELECT c_nationkey, sum(c_acctbal) AS total FROM customer GROUP BY 1) SELECT c_custkey, round(100 * c_acctbal / total, 6) AS share FROM customer AS c LEFT JOIN t ON c.c_nationkey = t.c_nationkey")
def share_of_total_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    total = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("total"))
    return c.join(total, "c_nationkey", "left").select("c_custkey", F.round(ieee_div(F.col("c_acctbal") * 100, F.col("total")), 6).alias("share"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, o_orderkey IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, 1 AS o_orderkey FROM orders) ON c_custkey = o_custkey")
def left_join_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("matched", F.lit(True))
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left").select("c_custkey", F.coalesce("matched", F.lit(False)).alias("matched"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS status FROM orders")
def value_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", replace_values("o_orderstatus", {"O": "open", "F": "final"}).alias("status"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name, CAST(NULL AS DOUBLE) AS extra FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number meets text in one column; the other columns are on one side only."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return union_by_name(a, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("k"), F.col("s_acctbal").alias("extra")))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') END AS month FROM orders")
def try_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_orderkey") % 4 != 0
    text = F.when(ok, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise("nonsense")
    stamp = F.when(ok, F.date_format("o_orderdate", "yyyyMM")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", to_date(text, "%Y.%m.%d").cast("string").alias("day"), to_date(stamp, "%Y%m").cast("string").alias("month"))


@query("SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS padded FROM nation")
def zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", zfill("n_nationkey", 2).alias("padded"))


@query("SELECT c_custkey, lower(c_name) AS name FROM customer WHERE c_name LIKE '%7'")
def ends_with_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_name").endswith("7")).select("c_custkey", F.lower("c_name").alias("name"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT max(o_orderkey) AS last_key, count(DISTINCT o_custkey) AS customers FROM orders")
def global_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last_key"), F.countDistinct("o_custkey").alias("customers"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) SELECT count(*) AS rows, count(*) - count(v) AS nulls, round(sum(coalesce(v, 1)), 4) AS filled, round(sum(v), 4) AS kept FROM e")
def null_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return e.agg(F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.round(F.sum(F.coalesce("v", F.lit(1))), 4).alias("filled"), F.round(F.sum("v"), 4).alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS level FROM orders")
def case_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "middle").otherwise("low").alias("level"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax - 0.04 = 0 THEN 'zero' ELSE 'other' END AS kind, isinf((l_quantity + 1) / (l_linenumber - 1)) AS infinite FROM lineitem")
def ieee_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ieee_div(F.col("l_quantity") + 1, (F.col("l_linenumber") - 1).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") - 0.04 == 0, "zero").otherwise("other").alias("kind"), (F.abs(q) == float("inf")).alias("infinite"))


@query("SELECT n_nationkey, s.name, s.region FROM (SELECT n_nationkey, {'name': n_name, 'region': n_regionkey} AS s FROM nation)")
def unnest_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("s")).select("n_nationkey", "s.*")


# lists: the lines of each order, in order

LISTS = "o AS (SELECT l_orderkey AS k, list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS s FROM lineitem GROUP BY l_orderkey)"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n (line numbers), q (quantities), s (suppliers) of each order."""
    li = table(spark, sf_dir, "lineitem")
    e = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    packed = li.groupBy(F.col("l_orderkey").alias("k")).agg(e.alias("e"))
    return packed.select("k", F.transform("e", lambda x: x["l_linenumber"].cast("long")).alias("n"), F.transform("e", lambda x: x["l_quantity"]).alias("q"), F.transform("e", lambda x: x["l_suppkey"]).alias("s"))


def opened_up(df: DataFrame, value, *columns: str) -> DataFrame:
    """One row for each element, with its place."""
    out = df.select("k", F.posexplode(value).alias("pos", "v"))
    return out.select("k", F.col("pos").cast("long").alias("pos"), *[F.col(f"v.{c}").alias(c) for c in columns]) if columns else out.select("k", F.col("pos").cast("long").alias("pos"), "v")


def rows_of(expression: str) -> str:
    return f"WITH {LISTS}, x AS (SELECT k, {expression} AS v FROM o) SELECT k, unnest(range(len(v))) AS pos, unnest(v) AS v FROM x"


@query(f"WITH {LISTS}, x AS (SELECT k, list_zip(n[1:len(n) - 1], q[1:len(n) - 1]) AS v FROM o), y AS (SELECT k, unnest(range(len(v))) AS pos, unnest(v) AS v FROM x) SELECT k, pos, v[1] AS first, v[2] AS second FROM y")
def list_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.slice("q", F.lit(1), F.size("q") - 1)
    return opened_up(lists(spark, sf_dir), list_ext("n").zip(short), "first", "second")


@query(rows_of("q"))
def list_unzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = lists(spark, sf_dir).select("k", list_ext(list_ext("n").zip("q")).unzip().alias("u"))
    return opened_up(back, F.col("u.second"))


@query(f"WITH {LISTS} SELECT k, unnest(range(len(q))) AS pos, unnest(range(len(q))) AS \"index\", unnest(q) AS \"value\" FROM o")
def list_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened_up(lists(spark, sf_dir), list_ext("q").enumerate(), "index", "value").withColumn("index", F.col("index").cast("long"))


PARITY = "list_transform(q, lambda z: CAST(z AS BIGINT) % 2)"


@query(f"WITH {LISTS}, p AS (SELECT k, {PARITY} AS a FROM o), i AS (SELECT k, a, list_filter(range(1, len(a) + 1), lambda j: j = 1 OR a[j] <> a[j - 1]) AS j FROM p), x AS (SELECT k, list_transform(j, lambda y: a[y]) AS v FROM i) SELECT k, unnest(range(len(v))) AS pos, unnest(v) AS v FROM x")
def list_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parity = lists(spark, sf_dir).select("k", F.transform("q", lambda z: z.cast("long") % 2).alias("p"))
    return opened_up(parity, list_ext("p").dedup())


@query(rows_of("list_concat(q[len(q) - 2 % len(q) + 1:], q[1:len(q) - 2 % len(q)])"))
def list_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened_up(lists(spark, sf_dir), list_ext("q").rotate(2))


@query(rows_of("list_transform(range(1, len(q) - 1, 2), lambda i: q[i] + q[i + 1] + q[i + 2])"))
def list_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened_up(lists(spark, sf_dir), F.transform(list_ext("q").windows(3, 2), lambda w: w[0] + w[1] + w[2]))


@query(rows_of("list_transform(range(1, len(q) + 1, 3), lambda i: list_sum(q[i:i + 2]))"))
def list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened_up(lists(spark, sf_dir), F.transform(list_ext("q").chunks(3), lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)))


def positions(op: str) -> str:
    return f"list_filter(range(len(q)), lambda i: q[i + 1] {op} 25)[1]"


@query(f"WITH {LISTS} SELECT k, {positions('=')} AS eq, {positions('<>')} AS ne, {positions('>')} AS gt, {positions('>=')} AS ge, {positions('<')} AS lt, {positions('<=')} AS le FROM o")
def list_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("k", *[list_ext("q").position(op, 25).cast("long").alias(op) for op in COMPARISONS])


@query(rows_of("list_transform(q, lambda z: round(z / 4, 6))"))
def list_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened_up(lists(spark, sf_dir), F.transform(list_ext("q").flat_map("div", 4), lambda x: F.round(x, 6)))


@query(rows_of("list_transform(q, lambda z: z * len(q) - 1)"))
def list_scalar_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = lists(spark, sf_dir).withColumn("m", operate_scalar_on_list("q", F.size("q"), "mul"))
    return opened_up(times, operate_scalar_on_list("m", F.lit(1), "sub"))


def joinable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (id: supplier modulo 5) and marks (id: line number, the last of equal ids wins)."""
    df = lists(spark, sf_dir)
    a = F.zip_with("s", "q", lambda s, q: F.struct((s % 5).alias("id"), q.alias("val")))
    b = F.zip_with("n", "s", lambda n, s: F.struct((n % 3).alias("id"), s.alias("mark")))
    return df.select("k", a.alias("a"), b.alias("b"))


LEFT = "a AS (SELECT k, unnest(range(len(q))) AS i, unnest(s) % 5 AS id, unnest(q) AS val FROM o)"
RIGHT = "b AS (SELECT k, id, arg_max(mark, j) AS mark FROM (SELECT k, unnest(range(len(n))) AS j, unnest(n) % 3 AS id, unnest(s) AS mark FROM o) GROUP BY k, id)"
PLACED = "CAST(row_number() OVER (PARTITION BY a.k ORDER BY i) - 1 AS BIGINT) AS pos"


@query(f"WITH {LISTS}, {LEFT}, {RIGHT} SELECT a.k, {PLACED}, a.id, val, mark FROM a JOIN b ON a.k = b.k AND a.id = b.id")
def list_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = joinable(spark, sf_dir)
    return opened_up(df, list_ext("a").join("b", "id", "inner", schema=df.schema), "id", "val", "mark")


@query(f"WITH {LISTS}, {LEFT}, {RIGHT} SELECT a.k, {PLACED}, a.id, val, mark FROM a LEFT JOIN b ON a.k = b.k AND a.id = b.id")
def list_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = joinable(spark, sf_dir)
    return opened_up(df, list_ext("a").join("b", "id", "left", schema=df.schema), "id", "val", "mark")


@query(f"WITH {LISTS}, {LEFT}, {RIGHT} SELECT a.k, {PLACED}, a.id, val FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k = b.k AND a.id = b.id)")
def list_join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = joinable(spark, sf_dir)
    return opened_up(df, list_ext("a").join("b", "id", "anti", schema=df.schema), "id", "val")


@query(ORACLE_SQL["list_join_left"])
def list_join_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for long lists: exploded, joined by (row, key), put together."""
    return opened_up(list_join_exploded(joinable(spark, sf_dir), "a", "b", "id", "left"), "joined", "id", "val", "mark")


def ranged(agg: str) -> str:
    return f"list_aggregate(list_transform(list_filter(list_zip(q, n), lambda z: z[2] >= 2 AND z[2] <= 6 AND NOT (z[2] >= 4 AND z[2] <= 4)), lambda z: z[1]), '{agg}')"


@query(f"WITH {LISTS} SELECT k, round({ranged('avg')}, 6) AS mean, round({ranged('median')}, 6) AS median, {ranged('sum')} AS sum, nullif(CAST({ranged('count')} AS DOUBLE), 0) AS count, {ranged('max')} AS max, {ranged('min')} AS min FROM o")
def list_agg_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda agg: agg_of_range("q", "n", agg, 2, 6, (4, 4))
    return lists(spark, sf_dir).select("k", *[(F.round(of(a), 6) if a in ("mean", "median") else of(a)).alias(a) for a in AGGREGATES])


EMB = "e AS (SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {EMB} SELECT label, CAST(pos AS BIGINT) AS pos, round(avg(x), 8) AS mean, round(sum(x), 6) AS total, CAST(count(x) AS DOUBLE) AS n FROM e GROUP BY label, pos")
def list_elementwise_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = table(spark, sf_dir, "embeddings"), None
    for agg, name in (("mean", "mean"), ("sum", "total"), ("count", "n")):
        part = aggregate_elementwise(e, ["label"], "embedding", 64, agg, "v").select("label", F.posexplode("v").alias("pos", name))
        out = part if out is None else out.join(part, ["label", "pos"])
    return out.select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 8).alias("mean"), F.round("total", 6).alias("total"), "n")


@query(f"WITH e AS (SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, CAST(pos AS BIGINT) AS pos, round(sum(x), 6) AS total FROM e GROUP BY label, pos")
def list_elementwise_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exploded plan, which lists of more than 64 positions get: here each list twice over, of which the first half is looked at."""
    e = table(spark, sf_dir, "embeddings").select("label", F.concat("embedding", "embedding").alias("l"))
    out = aggregate_elementwise(e, ["label"], "l", 128, "sum", "v").select("label", F.posexplode("v").alias("pos", "total"))
    return out.filter("pos < 64").select("label", F.col("pos").cast("long").alias("pos"), F.round("total", 6).alias("total"))


# signals: embeddings as samples

DFT = "SELECT vec_id, CAST(f AS BIGINT) AS pos, round(sqrt(pow(sum(x * cos(2 * pi() * f * i / 64)), 2) + pow(sum(x * sin(2 * pi() * f * i / 64)), 2)) / {by}, 6) AS v FROM {source}, range(33) AS r(f) GROUP BY vec_id, f"
SAMPLES = "(SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def signal_rows(df: DataFrame, value) -> DataFrame:
    out = df.select("vec_id", F.posexplode(value).alias("pos", "v"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query(DFT.format(by="1", source=SAMPLES))
def fft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_rows(table(spark, sf_dir, "embeddings"), apply_fft("embedding", 64))


@query("WITH w AS (SELECT sum(0.5 * (1 - cos(2 * pi() * i / 33))) AS s FROM range(33) AS t(i)) SELECT d.vec_id, d.pos, round(d.v / w.s, 6) AS v FROM w, (" + DFT.format(by="1", source=f"(SELECT vec_id, i, x * 0.5 * (1 - cos(2 * pi() * i / 64)) AS x FROM {SAMPLES})").replace("round(", "(").replace(", 6) AS v", ") AS v") + ") AS d")
def fft_hann_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_rows(table(spark, sf_dir, "embeddings"), apply_fft("embedding", 64, window="hanning", norm="window"))


@query(DFT.format(by="33", source=f"(SELECT vec_id, i, x * (0.54 - 0.46 * cos(2 * pi() * i / 63)) AS x FROM {SAMPLES})"))
def fft_hamming_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_rows(table(spark, sf_dir, "embeddings"), apply_fft("embedding", 64, window="hamming", norm="length"))


@query()
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: held against properties of the filter in the tests."""
    return signal_rows(table(spark, sf_dir, "embeddings"), apply_fft("embedding", 64, bp_min=4, bp_max=20, bp_ord=4, skip_fft=True))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS y FROM embeddings) SELECT vec_id, CAST(p AS BIGINT) AS pos, round(CASE WHEN p >= 63 / 1.5 THEN y[64] ELSE y[CAST(floor(p * 1.5) AS BIGINT) + 1] + (p * 1.5 - floor(p * 1.5)) * (y[CAST(floor(p * 1.5) AS BIGINT) + 2] - y[CAST(floor(p * 1.5) AS BIGINT) + 1]) END, 6) AS v FROM e, range(50) AS r(p)")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, at = F.array(*[F.lit(float(i)) for i in range(64)]), F.array(*[F.lit(i * 1.5) for i in range(50)])
    return signal_rows(table(spark, sf_dir, "embeddings"), interpolate_columns(x, "embedding", at))


@query("SELECT vec_id, CAST(f AS BIGINT) AS pos, round(f * 64 / 64 / (label + 1), 6) AS v FROM embeddings, range(33) AS r(f)")
def frequency_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.array(*[F.lit(f) for f in fft_freqs(33, 64)])
    return signal_rows(table(spark, sf_dir, "embeddings"), operate_scalar_on_list(axis, F.col("label") + 1, "div"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")

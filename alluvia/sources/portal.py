"""Sources on open-data portals that speak the CKAN API: new CSV files of a package, and monthly snapshots of one file.

Files are fetched by the driver, one at a time, into the shared folder, and read by Spark. ``fetch`` takes a URL and gives bytes, so a portal can
be replaced; a portal that is unavailable (HTTP 503) has nothing new.
"""

from __future__ import annotations

import csv
import io
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alluvia.functions.parsing import first_date, to_date
from alluvia.operators.merge import keep_last
from alluvia.sources.core import Batch, QuerySource, _read, scan_files
from alluvia.storage import Scratch

Fetch = Callable[[str], bytes]
NATURAL_KEYS = tuple("MONATSZAHL AUSPRAEGUNG JAHR MONAT".split())
MONTHLY = "MONATSZAHL string, AUSPRAEGUNG string, JAHR bigint, MONAT string, WERT double, VORJAHRESWERT double, VERAEND_VORMONAT_PROZENT double, VERAEND_VORJAHRESMONAT_PROZENT double, ZWOELF_MONATE_MITTELWERT double"


def http(url: str, timeout: float = 60) -> bytes:
    asked = urllib.request.Request(url)
    asked.add_header("User-Agent", "alluvia")
    with urllib.request.urlopen(asked, timeout=timeout) as answer:
        return answer.read()


def unavailable(e: Exception) -> bool:
    return isinstance(e, urllib.error.HTTPError) and e.code == 503


def resources(api_url: str, fetch: Fetch = http) -> list[dict[str, Any]]:
    """The resources of a package; an answer without success is an error."""
    answer = json.loads(fetch(api_url))
    if not answer.get("success"):
        raise RuntimeError(f"{api_url} answers without success")
    return answer["result"]["resources"]


def first_csv(api_url: str, fetch: Fetch = http) -> str:
    """The address of the first resource whose format is CSV, in any case."""
    for r in resources(api_url, fetch):
        if str(r.get("format", "")).lower() == "csv":
            return r["url"]
    raise RuntimeError(f"{api_url} lists no CSV file")


def repaired(data: bytes, renames: dict[str, str] | None = None) -> bytes:
    """A CSV file whose header begins with an unnamed, quoted column (an index) without that column; other files as they are."""
    text = data.decode("utf-8")
    if not text.startswith('""'):
        return data
    header, *rest = (r[1:] for r in csv.reader(io.StringIO(text)) if r)
    for old, new in (renames or {}).items():
        header = [c.replace(old, new) for c in header]
    lines = io.StringIO()
    csv.writer(lines).writerows([header, *rest])
    return lines.getvalue().encode()


class CkanSource:
    """New CSV files of packages; the cursor is the sorted list of addresses seen so far.

    api_urls: the packages. named: only resources whose name holds this. Files whose name holds ``skip`` are passed over (corrections that
    repeat others). A file is kept under its name, so it is fetched once."""

    def __init__(self, spark: SparkSession, api_urls: Sequence[str], folder: str, named: str = "", skip: str = "_korr", fetch: Fetch = http, renames: dict[str, str] | None = None, reader_kwargs: dict | None = None):
        self.spark, self.api_urls, self.folder, self.named, self.skip, self.fetch = spark, list(api_urls), folder.rstrip("/"), named, skip, fetch
        self.renames, self.reader_kwargs = renames or {"min.temp": "min-temp", "max.temp": "max-temp"}, reader_kwargs or {}

    def poll(self, since: Any) -> Batch | None:
        seen = {*since} if isinstance(since, list) else set()
        urls, paths = [], []
        try:
            for api in self.api_urls:
                for r in resources(api, self.fetch):
                    name = r["url"].rstrip("/").rsplit("/", 1)[-1]
                    if self.named in str(r.get("name", "")) and r["url"] not in seen and not (self.skip and self.skip in name):
                        paths.append(self._kept(r["url"], name))
                        urls.append(r["url"])
        except urllib.error.HTTPError as e:
            if unavailable(e):
                return None
            raise
        if not urls:
            return None
        frame = scan_files(self.spark, paths, "csv", self.reader_kwargs).drop("_source_file", "_ingested_at")
        return Batch(frame, sorted(seen | set(urls)))

    def _kept(self, url: str, name: str) -> str:
        path, fs = f"{self.folder}/{name}", Scratch(self.spark, "portal").fs
        if not fs.exists(path):
            fs.create(path, repaired(self.fetch(url), self.renames).decode("utf-8"))
        return path


def monthly_figures(df: DataFrame, source_file: str, now: datetime) -> DataFrame:
    """Without yearly sums, with the month as a date, one row for each natural key: the last that was read."""
    months = df.filter(F.col("MONAT") != "Summe")
    return keep_last(months, NATURAL_KEYS).withColumns({"date": to_date("MONAT", "%Y%m"), "_source_file": F.lit(source_file), "_ingested_at": F.lit(now).cast("timestamp")})


def snapshot_source(spark: SparkSession, name: str, folder: str, api_url: str | None = None, url: str | None = None, fetch: Fetch = http, clock: Callable[[], datetime] = datetime.now) -> QuerySource:
    """One file, fetched whole once a month. The cursor is the month, in a column ``_stamp`` that the transform drops."""
    if (api_url is None) == (url is None):
        raise ValueError(f"{name} needs the address of a package or of a file")

    def read(since: Any) -> DataFrame | None:
        today = clock()
        stamp = f"{today:%Y%m}"
        if stamp == since:
            return None
        path, fs = f"{folder.rstrip('/')}/{name}/{name}_{stamp}.csv", Scratch(spark, "portal").fs
        try:
            if not fs.exists(path):
                fs.create(path, fetch(url or first_csv(api_url, fetch)).decode("utf-8"))
        except urllib.error.HTTPError as e:
            if unavailable(e):
                return None
            raise
        raw = _read(spark, [path], "csv", {"null_values": "NA", "quote_char": '"', "schema_overrides": dict(x.rsplit(" ", 1) for x in MONTHLY.split(", "))})
        return monthly_figures(raw, path, clock()).withColumn("_stamp", F.lit(stamp))

    return QuerySource(read, "_stamp")


def counted_by_day(df: DataFrame, column: str = "datum") -> DataFrame:
    """The date from either of two notations, and its year."""
    parsed = df.withColumn(column, first_date(column, ["%Y.%m.%d", "%d.%m.%Y"]))
    return parsed.withColumn("year", F.year(column))

import io
import json
import urllib.error
from datetime import datetime

import pytest

from alluvia import VersionedTable, incremental, schema
from alluvia.sources import portal

MONTHS = """MONATSZAHL,AUSPRAEGUNG,JAHR,MONAT,WERT,VORJAHRESWERT,VERAEND_VORMONAT_PROZENT,VERAEND_VORJAHRESMONAT_PROZENT,ZWOELF_MONATE_MITTELWERT
"Unfälle",insgesamt,2023,Summe,100,90,NA,NA,NA
"Unfälle",insgesamt,2023,202301,8,7,1.5,NA,NA
"Unfälle",insgesamt,2023,202302,9,7,1.5,NA,NA
"Unfälle",insgesamt,2023,202302,10,7,1.5,NA,NA
"Unfälle",insgesamt,2023,odd,1,7,1.5,NA,NA
"""


class Portal:
    def __init__(self, files, listed=None, success=True):
        self.files, self.success, self.calls, self.down = files, success, [], 0
        self.listed = listed or [{"url": u, "name": "15 Minuten", "format": "csv"} for u in files]

    def __call__(self, url):
        self.calls.append(url)
        if self.down:
            raise urllib.error.HTTPError(url, self.down, "no", {}, io.BytesIO())
        if url == "api":
            return json.dumps({"success": self.success, "result": {"resources": self.listed}}).encode()
        return self.files[url].encode()


def test_first_csv_and_errors():
    assert portal.first_csv("api", Portal({}, [{"url": "x", "format": "PDF"}, {"url": "y", "format": "CSV"}])) == "y"
    for p in (Portal({}, [{"url": "x", "format": "PDF"}]), Portal({}, success=False)):
        with pytest.raises(RuntimeError):
            portal.first_csv("api", p)


def test_header_repair():
    assert portal.repaired(b"a,b\n1,2\n") == b"a,b\n1,2\n"
    assert portal.repaired(b'"","a","min.temp"\n"1","x","3"\n', {"min.temp": "min-temp"}).splitlines() == [b"a,min-temp", b"x,3"]


def test_new_files_of_a_package(spark, tmp_path):
    files = {"u/rad_1.csv": "datum,zaehlstelle,gesamt\n2024.01.05,A,1\n", "u/rad_1_korr.csv": "x\n1\n", "u/rad_2.csv": '"","datum","zaehlstelle","gesamt"\n"1","06.01.2024","B","NA"\n'}
    p = Portal(files)
    source = portal.CkanSource(spark, ["api"], f"{tmp_path}/files", named="15 Minuten", fetch=p, reader_kwargs={"null_values": "NA", "schema": "datum string, zaehlstelle string, gesamt long"})
    fn = schema({"datum": "string", "zaehlstelle": "string", "gesamt": "bigint"}, on_extra="drop", evolution="cast")(portal.counted_by_day)
    load = incremental(source=source, target=f"{tmp_path}/counts", partition_by="year")(fn)
    p.down = 503
    assert load.run() == []
    p.down = 404
    with pytest.raises(urllib.error.HTTPError):
        load.run()
    p.down = 0
    assert load.run() == [str(sorted(["u/rad_1.csv", "u/rad_2.csv"]))] and load.run() == []
    got = {(str(r.datum), r.zaehlstelle, r.gesamt, r.year) for r in VersionedTable(spark, load.target).scan().collect()}
    assert got == {("2024-01-05", "A", 1, 2024), ("2024-01-06", "B", None, 2024)}


def test_monthly_snapshots(spark, tmp_path):
    now = [datetime(2024, 5, 3)]
    p = Portal({"u/m.csv": MONTHS})
    source = portal.snapshot_source(spark, "accidents", f"{tmp_path}/files", api_url="api", fetch=p, clock=lambda: now[0])
    load = incremental(source=source, target=f"{tmp_path}/t", history_target=f"{tmp_path}/h", merge_on=list(portal.NATURAL_KEYS), scd_type=4)(lambda df: df.drop("_stamp"))
    assert load.run() == ["202405"] and load.run() == []
    rows = {(r.MONAT, r.WERT, str(r.date)) for r in VersionedTable(spark, load.target).scan().collect()}
    assert rows == {("202301", 8.0, "2023-01-01"), ("202302", 10.0, "2023-02-01"), ("odd", 1.0, "None")}
    now[0] = datetime(2024, 6, 1)
    p.down = 503
    assert load.run() == []
    p.down = 0
    assert load.run() == ["202406"] and VersionedTable(spark, f"{tmp_path}/h").scan().count() == 3
    with pytest.raises(ValueError):
        portal.snapshot_source(spark, "x", "y")

"""Files read back: daylight saving, duplicates, headers, caches, indexes, offers."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from meterflow.functions import clock
from meterflow.operators import market as market_ops
from meterflow.sources import files, market, meter, plans, prices

HEADER = "ESIID,USAGE_DATE,REVISION_DATE,USAGE_START_TIME,USAGE_END_TIME,USAGE_KWH,ESTIMATED_ACTUAL,CONSUMPTION_SURPLUSGENERATION"


def day_lines(date, rows=96, kwh="0.25", label="Consumption", start=0):
    return [f"'100,{date},,{(start + i) // 4 % 24:02d}:{(start + i) % 4 * 15:02d},,{kwh},A,{label}" for i in range(rows)]


def write(path, lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")


def labels(skip=(), twice=()):
    """Quarter-hour labels of a day in order, with an hour left out or repeated."""
    out = []
    for h in range(24):
        if h in skip:
            continue
        for _ in range(2 if h in twice else 1):
            out += [(h, q) for q in range(4)]
    return out


@pytest.mark.parametrize(("date", "hours", "n"), [("11/02/2025", {"twice": (1,)}, 100), ("03/08/2026", {"skip": (2,)}, 92), ("07/15/2025", {}, 96)])
def test_days_of_daylight_saving(spark, tmp_path, date, hours, n):
    lines = [f"'100,{date},,{h:02d}:{q * 15:02d},,{i},A,Consumption" for i, (h, q) in enumerate(labels(**hours))]
    lines[5] = lines[5].replace(":15", ":59")  # a wrong label does not matter: the day is whole
    write(tmp_path / "IntervalData1.csv", lines)
    rows = meter.load(spark, str(tmp_path)).orderBy("ts").collect()
    assert len(rows) == n and [r.import_kwh for r in rows] == list(range(n))
    assert (rows[-1].ts - rows[0].ts) == dt.timedelta(minutes=15 * (n - 1))
    if n == 100:
        assert rows[8].ts == dt.datetime(2025, 11, 2, 7, 0)


def test_short_days_are_dated_by_label(spark, tmp_path):
    second = [f"'100,11/02/2025,,01:00,,{k},A,Consumption" for k in (1, 2)]
    gap = ["'100,03/08/2026,,02:30,,9,A,Consumption", "'100,03/08/2026,,03:00,,3,A,Consumption"]
    write(tmp_path / "IntervalData1.csv", second + gap)
    read = meter.readings(meter.raw_rows(files.texts(spark, str(tmp_path), "*.csv")))
    got = {r.ts: r.import_kwh for r in meter.intervals(read).collect()}
    assert got == {dt.datetime(2025, 11, 2, 6, 0): 1.0, dt.datetime(2025, 11, 2, 7, 0): 2.0, dt.datetime(2026, 3, 8, 8, 0): 3.0}
    q = meter.quality(read).first()
    assert (q.dropped, q.rows_by_label) == (1, 4)


def test_blanks_channels_and_overlapping_files(spark, tmp_path):
    old, new = tmp_path / "IntervalDataB.csv", tmp_path / "IntervalDataA.csv"
    lines = day_lines("07/15/2025")
    for i in (0, 5, 10):
        lines[i] = lines[i].replace("0.25", "")
    write(old, lines + day_lines("07/15/2025", label="Surplus Generation", kwh="1") + ["'100,07/15/2025,,00:00,,7,A,Mystery"])
    import os

    os.utime(old, (time.time() - 1000, time.time() - 1000))
    write(new, day_lines("07/15/2025", 4, kwh="9"))
    raw = meter.raw_rows(files.texts(spark, str(tmp_path), "*.csv"))
    read = meter.readings(raw)
    rows = meter.intervals(read).orderBy("ts").collect()
    assert [(r.import_kwh, r.export_kwh) for r in rows[:6]] == [(9.0, 0.0)] * 4 + [(0.25, 1.0), (0.0, 1.0)]
    assert {r.blanks for r in meter.quality(read).collect()} == {3, 0}
    assert [r.label for r in meter.unknown_labels(raw).collect()] == ["Mystery"]


def price_files(spark, header, lines):
    return spark.createDataFrame([("p", "p", dt.datetime(2025, 1, 1), "\n".join([header, *lines]))], "path string, name string, modified timestamp, text string")


def test_price_times_in_both_shapes(spark):
    head = "Delivery Date,Delivery Hour,Delivery Interval,Repeated Hour Flag,Settlement Point Name,Settlement Point Price"
    lines = [f"11/02/2025,{h},1,{f},LZ_SOUTH,{p}" for h, f, p in ((1, "N", 10), (2, "N", 20), (2, "Y", 30), (3, "N", 40))] + ["07/15/2025,24,4,N,LZ_SOUTH,5", "07/15/2025,1,1,N,LZ_NORTH,7", "03/08/2026,3,3,N,LZ_SOUTH,8"]
    got = {r.ts: r.price_usd_kwh for r in prices.dated(prices.csv_prices(price_files(spark, head, lines)), "lz_south").collect()}
    hours = {dt.datetime(2025, 11, 2, 5 + k): 0.01 * (k + 1) for k in range(4)}
    assert got == pytest.approx(hours | {dt.datetime(2025, 7, 16, 4, 45): 0.005, dt.datetime(2026, 3, 8, 8, 0): 0.008})
    head = "DeliveryDate,DeliveryHour,DeliveryInterval,SettlementPointName,SettlementPointPrice,DSTFlag"
    lines = ["11/02/2025,2,1,LZ_SOUTH,20,Y", "11/02/2025,2,1,LZ_SOUTH,30,N"]
    assert {r.ts.hour for r in prices.dated(prices.csv_prices(price_files(spark, head, lines)), "LZ_SOUTH").collect()} == {6, 7}


def test_price_files_need_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DeliveryDate,DeliveryHour\n")
    with pytest.raises(ValueError, match="missing expected columns"):
        prices.load(spark, str(tmp_path))


def test_cache_follows_its_sources(spark, tmp_path):
    src, made = tmp_path / "src", []
    src.mkdir()

    def get():
        listing = files.listing(spark, str(src), "*.csv")
        return files.cached(spark, listing, lambda: made.append(1) or spark.createDataFrame([(len(made),)], "n int"), str(tmp_path / "cache")).first().n

    (src / "a.csv").write_text("x")
    (src / "~$a.csv").write_text("lock")
    assert (get(), get()) == (1, 1)
    (src / "b.csv").write_text("y")
    assert get() == 2
    (src / "a.csv").unlink()
    assert (get(), get()) == (3, 3)
    (src / "b.csv").unlink()
    with pytest.raises(Exception):
        files.cached(spark, files.listing(spark, str(tmp_path / "src"), "*.csv"), lambda: None, str(tmp_path / "none")).count()


def test_newest_market_list_with_other_headers(spark, tmp_path):
    import os

    (tmp_path / "old.csv").write_text("RepCompany,Product\nold,old\n")
    os.utime(tmp_path / "old.csv", (1, 1))
    (tmp_path / "new.csv").write_text('﻿"TduCompanyName","Rep Company",Product,TermValue,CancelFee,Prepaid,Fixed\nONCOR,"A, Inc."," P ",12,$9,N,1\nONCOR,B,,x,3,?,0\n')
    rows = market.load_list(spark, str(tmp_path)).collect()
    assert [(r.retailer, r.plan_name, r.term_months, r.cancel_fee, r.prepaid, r.rate_type) for r in rows] == [("A, Inc.", "P", 12, None, False, "fixed"), ("B", None, None, 3.0, None, "variable")]
    assert market_ops.filtered(market.load_list(spark, str(tmp_path)), retailer="a, i").count() == 1


def test_index_tables(spark, tmp_path):
    text = "Generated: 2026-07-01T00:00:00\n## Top Plans\n| TDU | Plan |\n|-|-|\n| x | y |\n## Meter Plan Availability\n| TDU | Provider | Plan | Term | Import rate | Export credit | Base fee | Early termination fee | Estimated annual cost | Source |\n|-|-|-|-|-|-|-|-|-|-|\n"
    text += "| Oncor | M | Saver + Battery | 12 | 10.5¢/kWh | Real Time Wholesale | $9.95 | $20 per month remaining | $1 | u |\n| short | row |\n| TNMP | M | Flat | 24 | 9 cents/kWh | 0¢/kWh | None | None | $2 | v |\n"
    (tmp_path / "i.md").write_text(text)
    rows = market.load_index(spark, str(tmp_path)).orderBy("plan_name").collect()
    assert [(r.plan_name, r.term_months, r.import_ckwh, r.export_kind, r.export_ckwh, r.base_usd_month, r.etf_usd, r.etf_per_month_remaining, r.battery_required) for r in rows] == [
        ("Flat", 24, 9.0, "none", 0.0, 0.0, 0.0, False, False),
        ("Saver + Battery", 12, 10.5, "rtw", None, 9.95, 20.0, True, True),
    ]
    assert rows[0].generated == dt.datetime(2026, 7, 1)
    assert market.filtered_index(market.load_index(spark, str(tmp_path)), "onc").count() == 1


def test_offers_in_pages(spark):
    offer = {"@id": "#o1", "name": "Plan", "areaServed": [{"@type": "AdministrativeArea", "name": "Oncor"}], "additionalProperty": [{"name": "Electricity Facts Label", "value": "https://x/e?a=1&b=2"}]}
    other = offer | {"@id": "#o2", "areaServed": [{"@type": "AdministrativeArea", "name": "TNMP"}]}
    bare = offer | {"@id": "#o3", "additionalProperty": []}
    html = "".join(f'<script type="application/ld+json">{x}</script>' for x in (json.dumps({"itemListElement": [offer, other, bare]}), "{broken", json.dumps([{"itemListElement": [offer]}])))
    rows = market.offers(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.page_id, r.offer_id, r.efl_url) for r in rows] == [(1, "o1", "https://x/e?a=1&b=2")]


def test_logs_append(spark, tmp_path):
    row = spark.createDataFrame([("R", "P", "u", dt.datetime(2026, 1, 1), "static", None, True, 3.0, "f.pdf")], "retailer string, plan_name string, source_url string, discovered_at timestamp, extraction_method string, llm_confidence double, is_buyback boolean, buyback_ckwh double, file string")
    market.log_downloads(row, str(tmp_path / "log"))
    market.log_downloads(row, str(tmp_path / "log"))
    assert market.downloads(spark, str(tmp_path / "log")).count() == 2


def test_work_by_host_sees_each_host_once(spark):
    urls = [f"https://h{i % 3}.example/{i}" for i in range(30)]

    def work(frames):
        import os

        for f in frames:
            yield f.assign(pid=os.getpid())[["host", "url", "pid"]]

    rows = market.by_host(spark.createDataFrame([(u,) for u in urls], "url string"), work, "host string, url string, pid long").collect()
    assert len(rows) == 30 and len({(r.host, r.pid) for r in rows}) == 3


def test_plan_documents(spark, tmp_path):
    doc = {"id": "p", "retailer": "R", "name": "N", "term_months": 12, "energy_rates": [{"rate_ckwh": 1.0}]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    (tmp_path / "a.json").write_text(json.dumps(doc | {"id": "q", "_parse": {"confidence": {"energy_charge": 0.5}, "source_sha256": "h"}}))
    assert [(r.id, r.ord) for r in plans.load_plans(spark, str(tmp_path)).orderBy("ord").collect()] == [("q", 0), ("p", 1)]
    drafts = plans.load_drafts(spark, str(tmp_path))
    assert {r.id: r.source_sha256 for r in plans.plan_fields(drafts).collect()} == {"q": "h", "p": None}
    flagged = plans.flag_for_review(plans.load_plans(spark, str(tmp_path)), spark.createDataFrame([("p", "look")], "id string, note string"))
    assert {r.id: (r.needs_review, r.notes) for r in flagged.collect()}["p"] == (True, "look")
    plans.save_plans(plans.load_plans(spark, str(tmp_path)), str(tmp_path / "out"))
    (tmp_path / "c.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="duplicate id"):
        plans.load_plans(spark, str(tmp_path))


def test_clock(spark):
    wall = spark.sql("SELECT explode(array(TIMESTAMP'2025-11-02 01:30:00', TIMESTAMP'2026-03-08 02:30:00', TIMESTAMP'2025-07-01 12:00:00')) AS w")
    rows = wall.select("w", clock.is_ambiguous(F.col("w")).alias("a"), clock.is_missing(F.col("w")).alias("m"), clock.utc_of(F.col("w"), F.lit(True)).alias("u"), clock.utc_of(F.col("w"), F.lit(False), in_gap="null").alias("n")).orderBy("w").collect()
    assert [(r.a, r.m) for r in rows] == [(False, False), (True, False), (False, True)]
    assert [r.u for r in rows] == [dt.datetime(2025, 7, 1, 17), dt.datetime(2025, 11, 2, 7, 30), dt.datetime(2026, 3, 8, 8, 0)]
    assert [r.n for r in rows][1:] == [dt.datetime(2025, 11, 2, 6, 30), None]


def test_files_read_by_line_in_many_tasks_keep_their_order(spark, tmp_path):
    """A file cut into blocks, headers of two spellings, a byte-order mark: the same rows as from whole texts."""
    rows = [f"{i},x{i},{'y' * (i % 7)}" for i in range(400)]
    (tmp_path / "a.csv").write_text("\ufeffNo,Name,Rest\n" + "\n".join(rows) + "\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("name,NO\n" + "\n".join(f"z{i},{i}" for i in range(50)))
    spelled = {"no": ["No"], "name": ["Name"], "rest": ["Rest"]}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        by_line = files.file_lines(spark, str(tmp_path), "*.csv")
        assert by_line.rdd.getNumPartitions() > 5
        got = files.csv_rows(by_line, spelled).collect()
        heads = {r.path[-5:]: r.header for r in files.headers(by_line).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert heads == {"a.csv": ["no", "name", "rest"], "b.csv": ["name", "no"]}
    for name in ("a.csv", "b.csv"):
        mine = sorted((r.row, int(r.no)) for r in got if r.name == name)
        assert [n for _, n in mine] == list(range(len(mine))) and len({r for r, _ in mine}) == len(mine)
    whole = files.csv_rows(files.texts(spark, str(tmp_path), "*.csv"), spelled).collect()
    assert sorted(repr((r.name, r.no, r.rest)) for r in got) == sorted(repr((r.name, r.no, r.rest)) for r in whole)

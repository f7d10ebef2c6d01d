"""Readers and sinks on small files with known rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from graintide.sources import climate, prices, results

DAY = datetime.date(2025, 4, 5)


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(text)
        return str(path)

    return write


def test_archive_export(spark, put):
    path = put("a.csv", 'State,District Name,Market Name,Commodity,Variety,Grade,Min Price (Rs./Quintal),Max Price (Rs./Quintal),Modal Price (Rs./Quintal),Price Date\n Goa ,North, M1,Rice,Common,FAQ,"1,200","1,400.5",x,05 Apr 2025\nGoa,North,M1,Rice,Common,,1,2,3,2025-04-05\nGoa,North,M1,Rice,Common,FAQ,1,2,3,\nGoa,North,M1,,Common,FAQ,1,2,3,2025-04-05\n')
    rows = sorted(prices.agmarknet_csv(spark, path).collect(), key=lambda r: r.min_price)
    assert [r.arrival_date for r in rows] == [DAY, DAY]
    assert tuple(rows[1]) == ("Goa", "North", "M1", "Rice", "Common", "FAQ", DAY, 1200.0, 1400.5, None)
    assert rows[0].grade is None


def test_snapshot_wfp_and_canonical(spark, put):
    snap = put("s.csv", "State,District,Market,Commodity,Variety,Grade,Arrival_Date,Min_x0020_Price,Max_x0020_Price,Modal_x0020_Price\nGoa,North,M1,Rice,Common,FAQ,05/04/2025,1,2,nan\n")
    assert tuple(prices.datagov_csv(spark, snap).first()) == ("Goa", "North", "M1", "Rice", "Common", "FAQ", DAY, 1.0, 2.0, None)
    wfp = put("wfp.csv", "date,admin1,admin2,market,latitude,longitude,category,commodity,unit,price\n2025-04-05,Goa,North,M1,1,2,c,Rice,KG,30.5\n2025-04-05,,North,M1,1,2,c,Rice,KG,30.5\n2025-04-05,Goa,North,M1,1,2,c,Rice,KG,\n")
    rows = prices.wfp_csv(spark, wfp).collect()
    assert [tuple(r) for r in rows] == [("Goa", "North", "M1", "Rice", "Rice", "", DAY, None, None, 30.5)]
    own = put("c.csv", "state,district,market,commodity,variety,grade,arrival_date,min_price,max_price,modal_price\nGoa,North,M1,Rice,,,12/09/2026,1,2,3\nGoa,North,M1,Rice,,,2099-01-01,1,2,3\n")
    assert [r.arrival_date for r in prices.canonical_csv(spark, own).collect()] == ["12/09/2026", "2099-01-01"]


def test_formats_by_header(spark, put):
    put("f/a.csv", "State,District Name,Price Date\n1,2,3\n")
    put("f/b.csv", "State,Arrival_Date,Modal_x0020_Price\n1,2,3\nPrice Date,1,2\n")
    put("f/c.csv", "state,arrival_date\n1,2\n")
    put("f/d.csv", "date,admin1,admin2\n1,2,3\n")
    put("f/WFP_e.csv", "x,admin1\n1,2\n")
    path = put("f/z.csv", "foo,bar\n1,2\n")
    found = {r.file.split("/")[-1]: r.format for r in prices.detect_price_format(spark, path.rsplit("/", 1)[0]).collect()}
    assert found == {"a.csv": "agmarknet_historical", "b.csv": "data_gov_in_snapshot", "c.csv": "canonical", "d.csv": "wfp_food_prices", "WFP_e.csv": "wfp_food_prices", "z.csv": None}


def test_alias_headers(spark, put):
    path = put("x.csv", "Date,STATE,Mandi,Commodity,Price,Min_x0020_Price\n2025-04-05,Goa,M1,Rice,30,\n,Goa,M1,Rice,30,1\n2025-04-05,Goa,M1,,30,1\n")
    assert [tuple(r) for r in prices.alias_csv(spark, path).collect()] == [("Goa", "", "M1", "Rice", "FAQ", "FAQ", DAY, None, None, 30.0)]


def test_folder_is_ingested_once(spark, put, tmp_path):
    head = ",".join(prices.CANONICAL)
    put("drop/1.csv", f"{head}\nGoa,North,M1,Rice,,,2025-04-05,1,2,3\n")
    args = [str(tmp_path / x) for x in ("drop", "table", "state")]
    assert prices.ingest_folder(spark, *args).count() == 1
    put("drop/2.csv", f"{head}\nGoa,North,M2,Rice,,,2025-04-06,1,2,3\n")
    assert prices.ingest_folder(spark, *args).count() == 2
    assert prices.ingest_folder(spark, *args).count() == 2


def test_price_records(spark, put):
    path = put("r.json", "\n".join(json.dumps(r) for r in ({"State": "Goa", "Commodity": "Rice", "Commodity_Code": 3, "Arrival_Date": "05/04/2025", "Modal_Price": "12.5", "Grade": ""}, {"state_name": "Goa", "market_name": "M1", "arrival_date": "2099-01-01", "modal_price": "n/a", "other": 1})))
    a, b = sorted(prices.price_json(spark, path, F.lit("2026-09-30").cast("date")).collect(), key=lambda r: r.market or "")
    assert (a.state, a.commodity, a.arrival_date, a.modal_price, a.grade) == ("Goa", "Rice", DAY, 12.5, None)
    assert (b.state, b.market, b.arrival_date, b.modal_price) == ("Goa", "M1", None, None)


def test_envelopes_and_cells(spark, put):
    names = lambda *rows: spark.createDataFrame(rows, "id int, name string")
    path = put("e.json", "\n".join(json.dumps(x) for x in ({"commodity_id": 1, "state_id": 2, "output": {"type": "ok", "data": [{"date": "2025-04-05T00:00", "census_district_id": 7, "p_min": 1, "modal_price": 2.5}, {"census_district_id": 7}]}}, {"commodity_id": 9, "state_id": 2, "records": [{"t": "2025-04-05", "district_id": 8}]}, {"output": {"data": []}})))
    a, b = sorted(prices.ceda_json(spark, path, names((2, "Goa")), names((7, "North")), names((1, "Rice")), "src").collect(), key=lambda r: r.commodity)
    assert tuple(a) == ("Goa", "North", "North", "Rice", "src", "src", DAY, 1.0, None, 2.5)
    assert (b.commodity, b.district) == ("id:9", "district 8")
    cells = put("m.json", "\n".join(json.dumps(x) for x in ({"t": "2025-04", "cmdty": "Rice", "district_name": "North", "p_modal": 3}, {"arrival_date": "bad", "commodity": "Rice"}, {"cmdty": "Rice"})))
    rows = sorted(prices.monthly_cell_json(spark, cells).collect(), key=lambda r: r.arrival_date is None)
    assert [(r.arrival_date, r.district, r.market, r.variety, r.modal_price) for r in rows] == [(datetime.date(2025, 4, 1), "North", "North", "Rice", 3.0), (None, "", "", "Rice", None)]


def test_climate_files(spark, put):
    rain = put("d.json", json.dumps({"sub_division": "S", "daily": {"time": ["2025-04-05", "2025-04-06"], "precipitation_sum": [1.5, None]}}))
    assert [tuple(r) for r in climate.daily_rain_json(spark, rain).collect()] == [("S", DAY, 1.5)]
    table = put("r.csv", "SUBDIVISION,Year,Month,RAINFALL,NORMAL,Anomaly\nS,2025,4,50,100,\nS,2025,5,50,0,\nS,2025,6,50,100,7\n,2025,7,1,1,1\nS,x,7,1,1,1\n")
    assert sorted((r.month, r.departure_pct) for r in climate.rain_csv(spark, table).collect()) == [(4, -50.0), (5, None), (6, 7.0)]
    entry = lambda day, mean, n, none: {"interval": {"from": f"{day}T00:00:00Z"}, "outputs": {"default": {"bands": {"B0": {"stats": {"mean": mean, "sampleCount": n, "noDataCount": none}}}}}}
    stats = put("n.json", json.dumps({"district": "North", "data": [entry("2025-04-05", 0.123456, 10, 4), entry("2025-04-06", "NaN", 10, 4), entry("2025-04-07", 0.5, 10, 10)]}))
    assert [tuple(r) for r in climate.ndvi_stats_json(spark, stats).collect()] == [("North", DAY, 0.1235, 6)]
    years = put("y.json", json.dumps({"records": [{"year": "1902", "jun": "5.5", "jul": 3, "jun_sep": "NA"}, {"year": 1901, "jun": 1}, {"year": "x"}]}))
    assert [(r.year, r.jun, r.jul, r.jun_sep) for r in climate.monsoon_json(spark, years).collect()] == [(1901, 1.0, None, None), (1902, 5.5, 3.0, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Goa", "Rice", DAY, 1.5, float("nan"), None)], "state string, commodity string, arrival_date date, modal_price double, min_price double, extra string")
    path = prices.written_canonical(rows, str(tmp_path / "c"))
    assert [tuple(r) for r in prices.canonical_csv(spark, path).collect()] == [("Goa", None, None, "Rice", None, None, "2025-04-05", None, None, 1.5)]
    table = str(tmp_path / "t")
    for run, n in (("a", 3), ("b", 2), ("a", 1)):
        results.append_results(spark.range(n), table, run)
    assert results.results(spark, table).count() == 3 and results.results(spark, table, "a").count() == 1
    results.export(results.results(spark, table), str(tmp_path / "e"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 3

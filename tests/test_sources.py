import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberline.plans import gold, refresh, silver
from emberline.plans.refresh import Lake
from emberline.sources import files, http, xml

XML = """<d:feed xmlns:d="urn:x"><d:situationRecord id="r1"><d:latitude>40.1</d:latitude><d:to><d:latitude>1</d:latitude></d:to><d:longitude>-3.7</d:longitude>
<d:overallStartTime>2024-01-01T10:00:00</d:overallStartTime></d:situationRecord><d:situationRecord id="r2"/></d:feed>"""


def test_xml_first_value_wins():
    assert list(xml.records_of(XML.encode())) == [("r1", {"latitude": "40.1", "longitude": "-3.7", "overallStartTime": "2024-01-01T10:00:00"})]
    assert list(xml.records_of(b"<broken")) == []


def test_landing_to_gold(spark, tmp_path):
    fires = "latitude,longitude,acq_date,acq_time,bright_ti4,bright_ti5,frp,confidence,daynight\n40.1,-3.7,2024-01-15,130,300,290,55,h,N\n40.11,-3.7,2024-01-15,140,300,290,60,h,N\n60,0,2024-01-15,140,300,290,60,h,N\n"
    weather = [{"latitude": 40.1, "longitude": -3.7, "elevation": 1.0, "timezone": "UTC", "hourly": {"time": ["2024-01-15T02:00", "2024-01-15T03:00"], "temperature_2m": [36.0], "relative_humidity_2m": [10, 20], "precipitation": [0.0, 0.5], "wind_speed_10m": [41.0, 1.0]}}]
    roads = {"elements": [{"type": "way", "id": 7, "nodes": [1, 2], "tags": {"highway": "motorway", "maxspeed": "50 mph", "lanes": "3"}, "geometry": [{"lat": 40.12, "lon": -3.71}]}]}
    for name, text in {"fires/2024/f.csv": fires, "weather/w.json": json.dumps(weather), "roads/r.json": json.dumps(roads), "traffic/t.xml": XML}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    lake = Lake(spark, f"file://{tmp_path}/lake", clock=lambda: dt.datetime(2024, 1, 15, 12))
    lake.bronze({"fires_nrt": f"{tmp_path}/fires", "weather": f"{tmp_path}/weather", "roads": f"{tmp_path}/roads", "traffic": f"{tmp_path}/traffic"})
    lake.silver()
    lake.gold(F.lit("2024-01-15 01:45:00").cast("timestamp"))
    found = lake.table("silver_fires").read()
    assert found.count() == 2 and found.select("cluster_id").distinct().count() == 1
    road = lake.table("silver_roads").read().first()
    assert (road.max_speed_kmh, road.lanes_count, road.centroid_latitude) == (None, 3, 40.12)
    assert {r.fire_risk_level for r in lake.table("gold_fire_risk").read().collect()} == {"CRITICAL", "MEDIUM"} or lake.table("gold_fire_risk").read().count() == 4
    assert lake.table("gold_fire_exposure").read().select("exposure_level").distinct().first()[0] == "HIGH"
    assert lake.table("gold_evacuation_routes").read().count() == 2 and lake.table("gold_fire_traffic_impact").read().count() == 2
    assert set(lake.status.values()) == {"ok"}
    assert files.latest_file(spark, f"{tmp_path}/roads").endswith("r.json")
    assert silver.KEYS["silver_roads"] == ["osm_way_id"]


def test_http(tmp_path):
    clock = lambda: dt.datetime(2024, 1, 2, 3, 4, 5)
    ok = lambda m, u, o: http.Response(200, b"a,b\n1,2\n")
    path = http.fire_nrt_feed("u", str(tmp_path), transport=ok, clock=clock).fetch_to_landing()
    assert path.endswith("2024/01/02/03/fires_nrt_20240102_030405.csv") and open(path).read() == "a,b\n1,2\n"
    assert http.traffic_feed("u", str(tmp_path), transport=ok).fetch_to_landing() is None
    assert http.fire_history_feed("u", str(tmp_path), transport=lambda *a: http.Response(500)).fetch_to_landing() is None

    def down(*a):
        raise OSError

    assert http.Client(transport=down).get_text("u") is None
    slept = []
    with pytest.raises(RuntimeError):
        http.RoadSource(str(tmp_path), ("a", "b"), transport=down, sleep=slept.append).fetch()
    assert slept == [10, 20, 10, 20]
    answers = [http.Response(429, headers={"Retry-After": "3"}), http.Response(200, b'{"hourly": {}}')]
    slept.clear()
    assert http.WeatherSource("u", str(tmp_path), transport=lambda *a: answers.pop(0), sleep=slept.append).fetch([(1.0, 2.0)]) == [{"hourly": {}}]
    assert slept == [8]


def test_days_of_a_lake(spark, tmp_path):
    """Files are read once; an incident that a day's file lacks is closed at that day, stays
    so while nothing new comes, and opens again; impacts of earlier days stay."""
    record = '<d:situationRecord id="{}"><d:latitude>40.1</d:latitude><d:longitude>-3.7</d:longitude><d:overallStartTime>2024-01-15T00:30:00</d:overallStartTime></d:situationRecord>'
    days = [("r1", "r2"), ("r1",), None, ("r1", "r2", "r3"), ("r1", "r3")]
    (tmp_path / "traffic").mkdir()
    (tmp_path / "fires").mkdir()
    (tmp_path / "fires/f.csv").write_text("acq_time,latitude,longitude,acq_date,frp\n130,40.1,-3.7,2024-01-15,55\n")
    ends, read, impacts = [], [], []
    for day, ids in enumerate(days, 1):
        if ids:
            (tmp_path / f"traffic/t{day}.xml").write_text('<d:feed xmlns:d="urn:x">' + "".join(map(record.format, ids)) + "</d:feed>")
        lake = Lake(spark, f"file://{tmp_path}/lake", clock=lambda day=day: dt.datetime(2024, 2, day))
        lake.bronze({"traffic": f"{tmp_path}/traffic", "fires_nrt": f"{tmp_path}/fires"})
        lake.silver()
        ends.append({r.record_id: r.end_timestamp and r.end_timestamp.day for r in lake.table("silver_traffic").read().collect()})
        read.append(files.read_raw(spark, f"file://{tmp_path}/lake/raw/traffic").count())
        try:
            lake.gold(F.lit("2024-01-15 01:45:00").cast("timestamp"))
        except refresh.StagesFailed as e:  # there are no roads and no weather
            assert "gold_fire_traffic_impact" not in e.errors
        impacts.append({r.traffic_incident_id for r in lake.table("gold_fire_traffic_impact").read().collect()})
    assert ends == [{"r1": None, "r2": None}, {"r1": None, "r2": 2}, {"r1": None, "r2": 2}, {"r1": None, "r2": None, "r3": None}, {"r1": None, "r2": 5, "r3": None}]
    assert read == [2, 3, 3, 6, 8] and impacts[-1] == {"r1", "r2", "r3"}
    stored = lake.table("gold_fire_traffic_impact")
    assert stored.read().columns == [c.strip().split(" ")[0] for c in gold.TRAFFIC_IMPACT.split(",")] and not stored.create(gold.TRAFFIC_IMPACT)
    assert lake.table("bronze_fires_nrt").read().first().updated_timestamp is None
    assert len(stored.versions()) <= 3
    stored.drop()
    assert stored.read() is None


def test_http_client_and_sources(tmp_path):
    """Error answers are no data; json bodies; the road query; batches below the rate."""
    assert http.Client(transport=lambda *a: http.Response(404, b"not found")).get_text("u") is None
    assert http.Client(transport=lambda *a: http.Response(503, b"{}")).get_json("u") is None
    assert http.Client(transport=lambda *a: http.Response(200, b'{"a": 1}')).get_json("u") == {"a": 1}
    seen = []

    class Open:
        status, headers = 200, {}

        def __init__(self, request, timeout):
            seen.append((request.get_method(), request.full_url, request.data, dict(request.header_items())))

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"ok"

    real, http.urllib.request.urlopen = http.urllib.request.urlopen, Open
    try:
        assert http.Client().post("http://x/y", json={"a": [1]}).text == "ok" and http.Client().get("http://x/y", params={"q": "1 2"}).status == 200
    finally:
        http.urllib.request.urlopen = real
    assert seen[0][:3] == ("POST", "http://x/y", b'{"a": [1]}') and seen[0][3]["Content-type"] == "application/json" and seen[1][1] == "http://x/y?q=1+2"

    asked = []

    def road(method, url, options):
        asked.append((method, url, options["data"]["data"], options["timeout"]))
        return http.Response(200, b'{"elements": []}') if url == "b" else http.Response(504)

    clock = lambda: dt.datetime(2024, 1, 2, 3, 4, 5)
    path = http.RoadSource(str(tmp_path), ("a", "b"), transport=road, sleep=lambda s: None, clock=clock).fetch_to_landing()
    assert json.load(open(path)) == {"elements": []} and path.endswith("2024/01/02/roads_20240102_030405.json")
    assert [a[1] for a in asked] == ["a", "a", "b"] and asked[0][3] == 300
    assert all(f'way["highway"="{c}"](27.0,-18.5,44.0,5.0);' in asked[0][2] for c in ("motorway", "trunk", "motorway_link", "trunk_link")) and asked[0][2].startswith("[out:json][timeout:180]") and asked[0][2].endswith("out qt body geom;")

    batches, slept, now = [], [], [0.0]

    def weather(method, url, options):
        n = len(options["params"]["latitude"].split(","))
        batches.append(n)
        return http.Response(200, json.dumps([{"i": i} for i in range(n)]).encode())

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = http.RateLimiter(most=100, window_s=60, clock=lambda: now[0], sleep=sleep)
    source = http.WeatherSource("u", str(tmp_path), transport=weather, sleep=sleep, limiter=limiter, clock=clock)
    assert len(source.fetch([(float(i), 1.0) for i in range(230)])) == 230
    assert batches == [50, 50, 50, 50, 30] and slept == [60.0, 60.0]
    assert source.run([(1.0, 2.0)]).endswith("2024/01/02/03/weather_20240102_030405.json")

"""The feeds as Spark data sources, without landing files.

register(spark) makes them known: spark.read.format("emberline_forecasts"),
"emberline_traffic", "emberline_fires" and "emberline_roads", each with the option `url`.
What they read are the rows that reading the landing file of the same answer gives,
without lineage. A subclass may set another `transport` (see http).
"""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import http
from .files import WEATHER_JSON
from .xml import records_of

FIRE_TEXT = "latitude string, longitude string, bright_ti4 string, scan string, track string, acq_date string, acq_time string, satellite string, confidence string, version string, bright_ti5 string, frp string, daynight string"
ROAD_ROWS = "id bigint, type string, nodes array<bigint>, tags map<string,string>, geometry array<struct<lat: double, lon: double>>"


class NoAnswer(RuntimeError):
    """A feed that gave no usable answer."""


@dataclass
class Batch(InputPartition):
    """Points that one request asks for, not before a time of the clock."""

    points: list
    not_before: float


class _Source(DataSource):
    transport = staticmethod(http.urllib_transport)
    sleep = staticmethod(time.sleep)
    rows = ""

    def schema(self) -> str:
        return self.rows

    def reader(self, schema: object) -> DataSourceReader:
        return self.made(dict(self.options), type(self).transport, type(self).sleep)


class _Whole(DataSourceReader):
    """A feed of one document, read by one task."""

    least_bytes, headers = 0, {}

    def __init__(self, options: dict, transport: http.Transport, sleep):  # noqa: ANN001
        self.options, self.transport, self.sleep = options, transport, sleep

    def answer(self) -> http.Response:
        got = http.Client(45, self.transport).get(self.options["url"], headers=self.headers)
        if got is None or got.status != 200 or len(got.body) < self.least_bytes:
            raise NoAnswer(f"{self.options['url']} gave no usable answer")
        return got


class _Traffic(_Whole):
    least_bytes, headers = 100, {"User-Agent": "emberline/1"}

    def read(self, partition: object) -> Iterator[tuple]:
        yield from records_of(self.answer().body)


class TrafficFeed(_Source):
    """(record_id, values) of the incidents of a traffic feed."""

    rows, made = "record_id string, values map<string,string>", _Traffic

    @classmethod
    def name(cls) -> str:
        return "emberline_traffic"


class _Fires(_Whole):
    def read(self, partition: object) -> Iterator[tuple]:
        names = [c.split(" ")[0] for c in FIRE_TEXT.split(", ")]
        for row in csv.DictReader(io.StringIO(self.answer().text)):
            yield tuple(row.get(n) or None for n in names)


class FireFeed(_Source):
    """Detections of a feed of comma-separated lines, as text; files.FIRE_CSV has the types."""

    rows, made = FIRE_TEXT, _Fires

    @classmethod
    def name(cls) -> str:
        return "emberline_fires"


class _Roads(_Whole):
    def read(self, partition: object) -> Iterator[tuple]:
        source = http.RoadSource("", tuple(self.options["url"].split(",")), transport=self.transport, sleep=self.sleep)
        for e in source.fetch().get("elements") or []:
            shape = e.get("geometry")
            yield e.get("id"), e.get("type"), e.get("nodes"), e.get("tags"), shape and [(p.get("lat"), p.get("lon")) for p in shape]


class RoadFeed(_Source):
    """The elements of a road service; option url: endpoints, comma-separated."""

    rows, made = ROAD_ROWS, _Roads

    @classmethod
    def name(cls) -> str:
        return "emberline_roads"


class _Forecasts(DataSourceReader):
    def __init__(self, options: dict, transport: http.Transport, sleep):  # noqa: ANN001
        self.options, self.transport, self.sleep = options, transport, sleep

    def partitions(self) -> list[Batch]:
        """A partition for each batch of points. The rate is shared by offset: as many
        batches as a minute allows may begin at once, the next ones a minute later."""
        points = json.loads(self.options["points"])
        size, most = int(self.options.get("batch", 50)), int(self.options.get("points_a_minute", 500))
        at_once, now = max(most // size, 1), time.time()
        batches = [points[i : i + size] for i in range(0, len(points), size)]
        return [Batch(b, now + 60.0 * (k // at_once)) for k, b in enumerate(batches)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        wait = partition.not_before - time.time()
        if wait > 0:
            self.sleep(wait)
        free = http.RateLimiter(most=1 << 60)
        source = http.WeatherSource(self.options["url"], "", batch=len(partition.points), transport=self.transport, sleep=self.sleep, limiter=free)
        for p in source.fetch([tuple(x) for x in partition.points]):
            hours = p.get("hourly")
            series = hours and tuple(hours.get(c) for c in ("time", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m"))
            yield p.get("latitude"), p.get("longitude"), p.get("elevation"), p.get("timezone"), series


class ForecastFeed(_Source):
    """Hourly forecasts; options: points (a JSON list of [latitude, longitude]), batch,
    points_a_minute."""

    rows, made = WEATHER_JSON, _Forecasts

    @classmethod
    def name(cls) -> str:
        return "emberline_forecasts"


FEEDS = (ForecastFeed, TrafficFeed, FireFeed, RoadFeed)


def register(spark: SparkSession) -> None:
    for feed in FEEDS:
        spark.dataSource.register(feed)

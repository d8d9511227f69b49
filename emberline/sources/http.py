"""Fetching feeds to landing files. The transport is a parameter: a function
(method, url, options) -> Response, by default over urllib."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any


@dataclass
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def text(self) -> str:
        return self.body.decode("utf-8", "replace")

    def json(self) -> Any:
        return json.loads(self.body)


Transport = Callable[[str, str, dict], Response]


def urllib_transport(method: str, url: str, options: dict) -> Response:
    headers = dict(options.get("headers") or {})
    data = urllib.parse.urlencode(options["data"]).encode() if options.get("data") else None
    if options.get("json") is not None:
        data = json.dumps(options["json"]).encode()
        headers.setdefault("Content-Type", "application/json")
    if options.get("params"):
        url = f"{url}?{urllib.parse.urlencode(options['params'])}"
    request = urllib.request.Request(url, data=data, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=options.get("timeout")) as r:
            return Response(r.status, r.read(), dict(r.headers))
    except urllib.error.HTTPError as e:
        return Response(e.code, e.read(), dict(e.headers))


class Client:
    """A plain client: None where a request gets no answer or one of status 400 and more."""

    def __init__(self, timeout: float = 90, transport: Transport = urllib_transport):
        self.timeout, self.transport = timeout, transport

    def _ask(self, method: str, url: str, **options: Any) -> Response | None:
        try:
            answer = self.transport(method, url, {"timeout": self.timeout, **options})
        except Exception:
            return None
        return answer if answer.status < 400 else None

    def get(self, url: str, **options: Any) -> Response | None:
        return self._ask("GET", url, **options)

    def post(self, url: str, **options: Any) -> Response | None:
        return self._ask("POST", url, **options)

    def get_text(self, url: str, **options: Any) -> str | None:
        return r.text if (r := self.get(url, **options)) is not None else None

    def get_json(self, url: str, **options: Any) -> Any:
        return r.json() if (r := self.get(url, **options)) is not None else None


def landing_path(base: str, stem: str, suffix: str, now: datetime, hourly: bool = False) -> str:
    """base/yyyy/MM/dd[/HH]/stem_time.suffix: batch feeds by day, others by hour."""
    parts = [now.strftime(p) for p in ("%Y", "%m", "%d", *(["%H"] if hourly else []))]
    return "/".join([base.rstrip("/"), *parts, f"{stem}_{now.strftime('%Y%m%d_%H%M%S')}.{suffix}"])


def land(path: str, body: bytes) -> str:
    """Writes the bytes as they came, under a name of its own first."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(body)
    os.replace(f"{path}.part", path)
    return path


@dataclass
class Feed:
    """A feed of one document: None unless the answer is 200 and long enough."""

    url: str
    base: str
    stem: str
    suffix: str = "csv"
    hourly: bool = False
    timeout: float = 45
    least_bytes: int = 0
    headers: dict[str, str] = field(default_factory=dict)
    transport: Transport = urllib_transport
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)

    def fetch_to_landing(self) -> str | None:
        answer = Client(self.timeout, self.transport).get(self.url, headers=self.headers)
        if answer is None or answer.status != 200 or len(answer.body) < self.least_bytes:
            return None
        return land(landing_path(self.base, self.stem, self.suffix, self.clock(), self.hourly), answer.body)


def fire_history_feed(url: str, base: str, **options: Any) -> Feed:
    return Feed(url, base, "fires_hist", timeout=45, **options)


def fire_nrt_feed(url: str, base: str, **options: Any) -> Feed:
    return Feed(url, base, "fires_nrt", hourly=True, timeout=30, **options)


def traffic_feed(url: str, base: str, **options: Any) -> Feed:
    return Feed(url, base, "traffic", suffix="xml", hourly=True, timeout=30, least_bytes=100, headers={"User-Agent": "emberline/1"}, **options)


def with_failover(endpoints: Iterable[str], ask: Callable[[str], Any], attempts: int = 2, pause_s: float = 10, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The first answer that isn't None: every endpoint in turn, with growing pauses."""
    for endpoint in endpoints:
        for attempt in range(1, attempts + 1):
            try:
                if (answer := ask(endpoint)) is not None:
                    return answer
            except Exception:  # the next attempt decides
                pass
            sleep(pause_s * attempt)
    raise RuntimeError("no endpoint gave an answer")


@dataclass
class RoadSource:
    """Main roads of a box from an Overpass service, with failover between endpoints."""

    base: str
    endpoints: tuple[str, ...]
    box: tuple[float, float, float, float] = (27.0, -18.5, 44.0, 5.0)
    classes: tuple[str, ...] = ("motorway", "trunk", "motorway_link", "trunk_link")
    transport: Transport = urllib_transport
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)

    def query(self) -> str:
        area = ",".join(map(str, self.box))
        ways = "".join(f'way["highway"="{c}"]({area});' for c in self.classes)
        return f"[out:json][timeout:180][maxsize:{1 << 30}];({ways});out qt body geom;"

    def fetch(self) -> dict:
        def ask(endpoint: str) -> dict | None:
            r = self.transport("POST", endpoint, {"data": {"data": self.query()}, "timeout": 300, "headers": {"User-Agent": "emberline/1"}})
            return r.json() if r.status == 200 else None

        return with_failover(self.endpoints, ask, sleep=self.sleep)

    def fetch_to_landing(self) -> str:
        data = json.dumps(self.fetch(), ensure_ascii=False).encode()
        return land(landing_path(self.base, "roads", "json", self.clock()), data)


class RateLimiter:
    """At most `most` units in a window of window_s seconds; more wait for the next."""

    def __init__(self, most: int = 500, window_s: float = 60, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.window_s, self.clock, self.sleep = most, window_s, clock, sleep
        self.used, self.start = 0, clock()

    def take(self, units: int) -> None:
        if self.clock() - self.start >= self.window_s:
            self.used, self.start = 0, self.clock()
        if self.used + units > self.most:
            self.sleep(max(0.0, self.window_s - (self.clock() - self.start)))
            self.used, self.start = 0, self.clock()
        self.used += units


@dataclass
class WeatherSource:
    """Hourly forecasts for points, in batches below the service's rate."""

    url: str
    base: str
    batch: int = 50
    retries: int = 5
    transport: Transport = urllib_transport
    sleep: Callable[[float], None] = time.sleep
    limiter: RateLimiter | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)

    def _batch(self, points: list[tuple[float, float]]) -> list[dict]:
        params = {"latitude": ",".join(str(p[0]) for p in points), "longitude": ",".join(str(p[1]) for p in points), "hourly": "temperature_2m,relative_humidity_2m,precipitation,wind_speed_10m", "forecast_days": 7, "timezone": "UTC"}
        for attempt in range(1, self.retries + 1):
            try:
                r = self.transport("GET", self.url, {"params": params, "timeout": 60})
            except Exception:
                self.sleep(10 * attempt)
                continue
            if r.status == 200:
                found = r.json()
                return found if isinstance(found, list) else [found]
            if r.status == 429:
                after = {k.lower(): v for k, v in r.headers.items()}.get("retry-after", "")
                self.sleep(int(after) + 5 if after.isdigit() else 65)
            else:
                self.sleep(10 * attempt)
        raise RuntimeError("the forecast service gave no answer")

    def fetch(self, points: list[tuple[float, float]]) -> list[dict]:
        limiter = self.limiter or RateLimiter(sleep=self.sleep)
        out: list[dict] = []
        for i in range(0, len(points), self.batch):
            part = points[i : i + self.batch]
            limiter.take(len(part))
            out += self._batch(part)
        return out

    def run(self, points: list[tuple[float, float]]) -> str:
        return land(landing_path(self.base, "weather", "json", self.clock(), hourly=True), json.dumps(self.fetch(points)).encode())

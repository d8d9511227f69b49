"""Landing to decision tables: each stage merges into versioned Parquet tables.

A stage that fails is reported and raises after the others have run, so one source
doesn't silently hold up the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.keyed import KeyedTable
from ..operators.merge import VersionedTable, lineage_merge, presence_merge, upsert_merge
from ..operators.storage import discard, written
from ..operators.tables import latest_per_key, sanitise_columns
from ..sources import files, xml
from ..sources.ledger import FileLedger
from . import gold, silver
from .declared import decision_table


#: Keys of the tables that loads are merged into.
MERGED = {n: k for n, k in silver.KEYS.items() if n != "silver_fires"} | {"gold_fire_traffic_impact": gold.IMPACT_KEYS}


class StagesFailed(RuntimeError):
    """Some stages failed; `errors` has them by name."""

    def __init__(self, errors: dict[str, Exception]):
        super().__init__("; ".join(f"{k}: {e}" for k, e in errors.items()))
        self.errors = errors


class MissingTable(LookupError):
    """A table that a decision table is made from and that the lake doesn't have yet."""


def _fire_files(spark: SparkSession, paths: list[str], now: Column, *, error: str) -> DataFrame:
    return files.read_csv(spark, paths, now, schema=files.FIRE_CSV).withColumn(error, F.lit(None).cast("string"))


def _road_files(spark: SparkSession, paths: list[str], now: Column, *, error: str) -> DataFrame:
    rows = files.read_json(spark, paths, now, files.ROADS_JSON, error=error)
    good = files.road_rows(rows.where(F.col(error).isNull()))
    return good.unionByName(rows.where(F.col(error).isNotNull()).drop("elements"), allowMissingColumns=True)


@dataclass
class Lake:
    """Tables below one folder, refreshed from landing folders. database: the catalog's
    database in which tables that are made anew each time can be read by name."""

    spark: SparkSession
    path: str
    database: str | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
    status: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> VersionedTable | KeyedTable:
        """A table that loads are merged into, or one that is made anew each time."""
        at = f"{self.path}/{name}"
        if name in MERGED:
            return KeyedTable(self.spark, at, MERGED[name])
        return VersionedTable(self.spark, at, name=self.database and f"{self.database}.{name}")

    def now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp_ntz")

    def raw(self, landing: dict[str, str]) -> None:
        """landing: folders by source, of weather, traffic, fires_nrt, fires_hist and roads.
        Files that the ledger has aren't read again; each is a snapshot of its own, in the
        order in which they were changed. What can't be read is told in the status. Of roads
        the newest file's rows replace the others."""
        self._all({f"raw_{s}": (lambda s=s, p=p: self._to_raw(s, p)) for s, p in landing.items()})

    def ledger(self) -> FileLedger:
        return FileLedger(self.spark, f"{self.path}/ledger")

    def _to_raw(self, name: str, path: str) -> str | None:
        """What of the new files can't be read, if anything; the rest is in RAW."""
        at, ledger = f"{self.path}/raw/{name}", self.ledger()
        pattern, read = {"weather": ("*.json", files.read_json), "traffic": ("*.xml", xml.read_xml), "roads": ("*.json", _road_files)}.get(name, ("*.csv", _fire_files))
        new = ledger.arrived(name, path, pattern, self.clock(), newest_only=name == "roads")
        if new is None:
            return None
        rows = written(new.stamped(read(self.spark, new.paths, self.now(), error="error")), "arrived")
        good = rows.where("error is null").drop("error")
        if not good.isEmpty():
            files.write_raw(good, at, append=name != "roads")
        faults = ledger.note(new, rows)
        discard(rows)
        return "; ".join(faults) or None

    def to_bronze(self, name: str, raw: DataFrame) -> int:
        """The last row of each key, merged where something changed. Rows with a null key
        are left out: they would be inserted again each time."""
        keys = silver.KEYS[name]
        clean = sanitise_columns(raw.drop("landing_source_path")).dropna(subset=keys)
        return self.table(name).merge(lineage_merge(latest_per_key(clean, keys), keys, self.now()))

    def bronze(self, landing: dict[str, str]) -> None:
        """Takes landing files to RAW (see raw) and RAW rows that came in since bronze was
        last changed to bronze."""
        try:
            self.raw(landing)
        finally:  # a source that failed doesn't hold up the rest
            self._all({f"bronze_{s}": (lambda s=s: self._to_bronze(s)) for s in landing})

    def _to_bronze(self, name: str) -> None:
        if (rows := files.read_raw(self.spark, f"{self.path}/raw/{name}")) is None:
            return
        if (old := self.table(f"bronze_{name}").read()) is not None:
            changed = old.agg(F.max(F.greatest("ingestion_timestamp", F.coalesce("updated_timestamp", "ingestion_timestamp"))).alias("t")).first().t
            rows = rows if changed is None else rows.where(F.col("ingestion_timestamp") > F.lit(changed).cast("timestamp_ntz"))
        self.to_bronze(f"bronze_{name}", rows)

    def to_silver(self, name: str, rows: DataFrame) -> int:
        keys = silver.KEYS[name]
        return self.table(name).merge(upsert_merge(rows, keys, self.now()))

    def silver(self) -> None:
        """An incident is closed when the first snapshot of the traffic feed was taken that
        lacks it, and open again once a later one has it."""
        self._all({"silver_weather": self._weather, "silver_fires": self._fires, "silver_traffic": self._traffic, "silver_roads": self._roads})

    def _weather(self) -> None:
        if (b := self.table("bronze_weather").read()) is not None:
            self.to_silver("silver_weather", silver.weather(b))

    def _fires(self) -> None:
        feeds = [b for n in ("bronze_fires_hist", "bronze_fires_nrt") if (b := self.table(n).read()) is not None]
        if feeds:
            fires, clusters = silver.fires(*feeds)
            self.table("silver_fires").write(fires.withColumn("updated_timestamp", self.now()))
            self.table("silver_fire_clusters").write(clusters.withColumn("updated_timestamp", self.now()))

    def _traffic(self) -> None:
        feed = files.read_raw(self.spark, f"{self.path}/raw/traffic")
        if feed is None or (b := self.table("bronze_traffic").read()) is None:
            return
        seen = feed.groupBy("record_id").agg(F.max("ingestion_timestamp").alias("snapshot"))
        gone = seen.join(self.ledger().snapshots("traffic"), "snapshot", "left").select("record_id", F.col("next").alias("gone_at"))
        self.table("silver_traffic").merge(presence_merge(silver.traffic(b), gone, "record_id", self.now()))

    def _roads(self) -> None:
        if (b := self.table("bronze_roads").read()) is not None:
            self.to_silver("silver_roads", silver.roads(b))

    def gold(self, as_of: Column) -> None:
        stored = {n: self.table(f"silver_{n}").read() for n in ("fires", "fire_clusters", "weather", "traffic", "roads")}
        fires, clusters, weather, incidents, roads = (t if t is None else t.drop("updated_source_file", "updated_timestamp") for t in stored.values())
        shared: dict[str, DataFrame] = {}

        def need(*names: str) -> None:
            missing = [f"silver_{n}" for n in names if stored[n] is None]
            if missing:
                raise MissingTable(f"{', '.join(missing)} must be made first")

        def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            if name not in shared:
                shared[name] = written(make(), name)
            return shared[name]

        near_roads = lambda: once("fire_roads", lambda: gold.fire_roads(fires, roads))
        at_roads = lambda: once("road_incidents", lambda: gold.road_incidents(roads, incidents))
        tables: dict[str, Callable[[], DataFrame]] = {
            "gold_fire_risk": lambda: need("fires", "weather") or gold.fire_risk(fires, weather, as_of),
            "gold_fire_evolution": lambda: need("fires", "fire_clusters") or gold.fire_evolution(stored["fires"], clusters),
            "gold_fire_exposure": lambda: need("fires", "roads") or gold.fire_exposure(near_roads()),
            "gold_fire_road_impact": lambda: need("fires", "roads", "traffic") or gold.fire_road_impact(near_roads(), at_roads()),
            "gold_evacuation_routes": lambda: need("fires", "roads", "traffic") or gold.evacuation_routes(near_roads(), at_roads()),
        }

        def traffic_impact() -> int:
            """Pairs of earlier refreshes stay; the one table that isn't made anew."""
            need("fires", "traffic")
            name = "gold_fire_traffic_impact"
            stored = self.table(name)
            stored.create(gold.TRAFFIC_IMPACT)
            return stored.merge(gold.traffic_impact_merge(gold.fire_traffic_impact(fires, incidents).withColumn("gold_updated_at", self.now())))

        stages = {n: (lambda n=n, t=t: self.table(n).write(decision_table(n, t().withColumn("gold_updated_at", self.now())))) for n, t in tables.items()}
        try:
            self._all({**stages, "gold_fire_traffic_impact": traffic_impact})
        finally:
            discard(*shared.values())

    def audit(self, *names: str) -> DataFrame:
        """(table_name, column_name, completeness) of the stored tables."""
        out = None
        for n in sorted(names):
            if (t := self.table(n).read()) is not None:
                row = audit.completeness(t).withColumn("table_name", F.lit(n))
                out = row if out is None else out.unionByName(row)
        return out

    def _all(self, stages: dict[str, Callable[[], object]]) -> None:
        """Runs stages one by one; the status of each is ok, failed or what it says itself."""
        errors: dict[str, Exception] = {}
        for name, run in stages.items():
            try:
                said = run()
                self.status[name] = said if isinstance(said, str) else "ok"
            except Exception as e:
                errors[name], self.status[name] = e, "failed"
        if errors:
            raise StagesFailed(errors)

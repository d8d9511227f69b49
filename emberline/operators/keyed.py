"""Tables whose merges write what they change.

A table is a folder of segments, Parquet files of one bucket each (a bucket is a hash of
the key), and of manifests. A manifest lists the segments that make up a version, with
their rows, bytes and the least and greatest key, and the places of rows in them that are
dead. A merge reads the segments of the buckets that the load touches and whose keys
overlap it; changed and new rows become new segments, and the old places of changed ones
are noted as dead. A bucket with too many dead rows or too many segments is rewritten in
the same step. A load that is large beside the table and updates all that it meets makes
the whole table anew: both are dealt to the new files once, and are met there. The next
manifest then takes the place of the last one by a rename, so readers see a whole version,
and the files that it doesn't name are left alone.

Compressed files tell little of their rows' size in memory, so loads are broadcast by
their number of rows alone, and dead places as bitmaps.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import Merge, quoted
from .storage import delete_folder, discard, written
from .tables import at_places, free_names

#: A load of so many rows at most is broadcast to find what it meets.
FEW_ROWS = 50_000


class VersionConflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


@dataclass(frozen=True)
class Segment:
    """A bucket's files in one folder. least, greatest: of the first key column, None where
    it isn't a number or string; dead: folders of places of dead rows."""

    bucket: int
    path: str
    rows: int
    bytes: int
    least: object = None
    greatest: object = None
    dead: tuple[str, ...] = ()
    dead_rows: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    segments: tuple[Segment, ...] = field(default=())

    def folders(self) -> set[str]:
        return {p.split("/")[0] for s in self.segments for p in (s.path, *s.dead)}

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Manifest:
        held = json.loads(text)
        segments = tuple(Segment(**{**s, "dead": tuple(s["dead"])}) for s in held.pop("segments"))
        return cls(**{**held, "keys": tuple(held["keys"])}, segments=segments)


class KeyedTable:
    """A table of rows with a key (see the module). buckets holds for a table that is made
    first; a bucket should hold a file or a few (rows_a_file). dead_share, most_segments:
    when a bucket is rewritten. The last `keep` versions can be read; files that none of
    them names are deleted. Rows of a null key are dealt to buckets by all their columns.
    Of two writers that start from one version one gets VersionConflict; the files that it
    wrote stay, as no version names them, until the table is dropped."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, buckets: int = 16, keep: int = 3, dead_share: float = 0.25, most_segments: int = 16, rows_a_file: int = 250_000):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.buckets, self.keep, self.dead_share, self.most_segments, self.rows_a_file = buckets, keep, dead_share, most_segments, rows_a_file

    # Manifests

    def _hadoop(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        files, at = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, of the last one without a version; None for no table."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        files, at = self._hadoop(f"{self.path}/manifests/{version:012d}.json")
        stream = files.open(at)
        try:
            return Manifest.of(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: Manifest) -> int:
        """Publishes a manifest: written beside its place, then renamed, which fails if
        another writer was first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files, at = self._hadoop(f"{self.path}/manifests/{manifest.version:012d}.json")
        beside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = files.create(beside, False)
        out.write(bytearray(manifest.text().encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(beside, at, options)
        except Exception as e:
            files.delete(beside, False)
            if files.exists(at):
                raise VersionConflict(f"{self.path} has a version {manifest.version} already") from e
            raise
        self._clean()
        return manifest.version

    def _clean(self) -> None:
        """Deletes manifests before the last `keep` and the folders that no kept one names."""
        found = self.versions()
        old, kept = found[: -self.keep], found[-self.keep :]
        if not old:
            return
        used = set().union(*(self.manifest(v).folders() for v in kept))
        gone = set().union(*(self.manifest(v).folders() for v in old)) - used
        for v in old:
            delete_folder(self.spark, f"{self.path}/manifests/{v:012d}.json")
        self._drop_folders(gone)

    # Reading

    def _rows(self, manifest: Manifest, segments: list[Segment], places: tuple[str, str] | None = None) -> DataFrame:
        """The live rows of segments, with the places (bucket and file's name, and row's number) at
        which they are stored if names for these are given."""
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        file, row = places or free_names([f.name for f in schema], "_file", "_row")
        whole, holed = [s for s in segments if not s.dead], [s for s in segments if s.dead]
        parts = []
        for group in (whole, holed):
            if not group:
                continue
            rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in group))
            if places or group is holed:
                meta = rows.metadataColumn("_metadata")
                rows = rows.select(*map(F.col, map(quoted, rows.columns)), F.regexp_extract(meta["file_path"], r"=(\d+/[^/]+)$", 1).alias(file), meta["row_index"].alias(row))
            if group is holed:
                dead = self.spark.read.schema("file string, row long").parquet(*sorted({f"{self.path}/{d}" for s in group for d in s.dead}))
                rows = at_places(rows, dead.toDF(file, row), file, row, keep=False)
            parts.append(rows if places else rows.select(*map(quoted, schema.names)))
        if not parts:
            extra = [T.StructField(file, T.StringType()), T.StructField(row, T.LongType())] if places else []
            return self.spark.createDataFrame([], T.StructType([*schema.fields, *extra]))
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, of the last one without a version; None for no table."""
        found = self.manifest(version)
        return None if found is None else self._rows(found, list(found.segments))

    # Writing

    def _bucket(self, df: DataFrame) -> Column:
        whole = reduce(lambda a, b: a & b, (F.col(quoted(k)).isNotNull() for k in self.keys))
        kinds = {f.name: f.dataType for f in df.schema}
        plain = [F.col(quoted(c)).cast("string") if isinstance(t, (T.MapType, T.StructType, T.ArrayType)) else F.col(quoted(c)) for c, t in kinds.items()]
        exact = lambda k: isinstance(kinds.get(k), (T.FloatType, T.DoubleType))
        own = [F.when(F.col(quoted(k)) == 0, F.lit(0).cast(kinds[k])).otherwise(F.col(quoted(k))) if exact(k) else F.col(quoted(k)) for k in self.keys]  # -0.0 is 0.0
        return F.pmod(F.when(whole, F.xxhash64(*own)).otherwise(F.xxhash64(*plain)), F.lit(self._many)).cast("int")

    @property
    def _many(self) -> int:
        return self._buckets_there or self.buckets

    _buckets_there: int | None = None

    def _places(self, df: DataFrame, total: int) -> tuple[Column, Column, int]:
        """The bucket and the file in it that rows belong in, and how many files there are;
        total: about how many the rows are."""
        files = max(1, -(-total // (self._many * self.rows_a_file)))
        spread = F.pmod(F.xxhash64(*(F.col(quoted(k)) for k in self.keys), F.lit("file")), F.lit(files)) if files > 1 else F.lit(0)
        return self._bucket(df), spread, min(self._many * files, 2000)

    def _store(self, df: DataFrame, total: int | None = None) -> list[Segment]:
        """Writes rows as segments, in order of the key. total: about how many they are, for
        rows of stored tables; others are stored for a while first."""
        rows = written(df, "load") if total is None else df
        (bucket,) = free_names(df, "_bucket")
        own, spread, files = self._places(rows, rows.count() if total is None else total)
        dealt = rows.withColumn(bucket, own).repartition(files, F.col(bucket), spread)
        out = self._segments(dealt.sortWithinPartitions(bucket, *map(quoted, self.keys)), bucket)
        discard(rows)
        return out

    def _segments(self, dealt: DataFrame, bucket: str) -> list[Segment]:
        """Writes rows as they are dealt and ordered."""
        name = f"rows-{uuid.uuid4().hex}"
        dealt.write.partitionBy(bucket).parquet(f"{self.path}/{name}")
        schema = T.StructType([f for f in dealt.schema if f.name.lower() == self.keys[0].lower() or f.name == bucket])
        first, prunes = F.col(quoted(self.keys[0])), isinstance(schema[0].dataType, (T.IntegralType, T.StringType))
        ends = (F.min(first), F.max(first)) if prunes else (F.lit(None), F.lit(None))
        facts = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").groupBy(bucket).agg(F.count("*"), *ends).collect()  # a row for each bucket
        out = []
        for b, n, least, greatest in sorted(map(tuple, facts), key=lambda f: f[0]):
            folder = f"{name}/{bucket}={b}"
            files, at = self._hadoop(f"{self.path}/{folder}")
            out.append(Segment(b, folder, n, files.getContentSummary(at).getLength(), least, greatest))
        if not out:
            self._drop_folders({name})
        return out

    def create(self, schema: str | T.StructType) -> bool:
        """An empty table of the schema, if there is no table yet; whether it was made."""
        if self.versions():
            return False
        kind = self.spark.createDataFrame([], schema).schema
        self._commit(Manifest(0, kind.json(), tuple(self.keys), self.buckets))
        return True

    def write(self, df: DataFrame, total: int | None = None) -> int:
        """The rows as the table's next version, in place of all others. total: see _store."""
        found = self.manifest()
        self._buckets_there = found.buckets if found else None
        return self._commit(Manifest(found.version + 1 if found else 0, df.schema.json(), tuple(self.keys), self._many, tuple(self._store(df, total))))

    def merge(self, load: Merge) -> int:
        """Merges a load (whose keys are the table's) and returns the version, the present one
        if nothing changes. Without a table its rows make one."""
        if [k.lower() for k in load.keys] != [k.lower() for k in self.keys]:
            raise ValueError(f"the table's key is {self.keys}, the load's {load.keys}")
        load = replace(load, source=written(load.source, "source"))
        try:
            return self._merge(load)
        finally:
            discard(load.source)

    def _merge(self, load: Merge) -> int:
        found = self.manifest()
        if found is None:
            return -1 if load.source.isEmpty() else self.write(load.applied(None), load.source.count())
        self._buckets_there = found.buckets
        schema = T.StructType.fromJson(json.loads(found.schema))
        fields = load.fields(schema)
        kind = self.spark.createDataFrame([], ", ".join(f"{quoted(c)} {t}" for c, t in fields.items())).schema
        touched, many = self._touched(found, load, schema)
        next_ = replace(found, version=found.version + 1, schema=kind.json())
        live = sum(s.rows - s.dead_rows for s in found.segments)
        if touched and load.update and not load.update_when and many > self.dead_share * live:
            return self._commit(replace(next_, segments=tuple(self._replaced(found, load, fields, live + many))))
        load.checked()
        file, row = free_names([*fields, *load.source.columns], "_file", "_row")
        t, s, on = load.sides(self._rows(found, list(found.segments) if load.not_matched else touched, (file, row)), fields, file, row)
        if many <= FEW_ROWS < sum(s.rows for s in touched) and not load.not_matched:  # of the table only what the load meets is shuffled
            t = t.join(F.broadcast(s.select(F.struct(*(F.col("s")[k].alias(k) for k in self.keys)).alias("s"))), on, "left_semi")
        how = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "full"}[load.insert is not None, bool(load.not_matched)]
        met = t.hint("merge").join(s.hint("merge"), on, how)
        rows = written(met.where(load.changes()).select(*load.outcome(fields), file, row), "changed")
        segments = self._changed(next_, rows, file, row)
        discard(rows)
        if segments is None:
            return found.version
        return self._commit(replace(next_, segments=tuple(segments)))

    def _drop_folders(self, names: set[str]) -> None:
        for name in names:
            delete_folder(self.spark, f"{self.path}/{name}")

    def _touched(self, found: Manifest, load: Merge, schema: T.StructType) -> tuple[list[Segment], int]:
        """The segments that may hold a key of the load, and how many keys it has."""
        first = F.col(quoted(self.keys[0]))
        kinds = {f.name.lower(): f.dataType.simpleString() for f in schema}
        typed = load.source.where(load.whole_keys()).select(*(F.col(quoted(k)).cast(kinds.get(k.lower(), "string")).alias(k) for k in self.keys))
        facts = typed.groupBy(self._bucket(typed)).agg(F.min(first), F.max(first), F.count("*")).collect()  # a row for each bucket
        ends = {r[0]: (r[1], r[2]) for r in facts}
        overlaps = lambda s: s.least is None or not (s.greatest < ends[s.bucket][0] or s.least > ends[s.bucket][1])
        return [s for s in found.segments if s.bucket in ends and overlaps(s)], sum(r[3] for r in facts)

    def _replaced(self, found: Manifest, load: Merge, fields: dict[str, str], total: int) -> list[Segment]:
        """The segments of the whole table after a load that updates all rows it meets. Rows of
        both sides are dealt to the files that are to hold their keys and gather by key there,
        so they are shuffled once; those of a null key meet none."""
        own = {k.lower() for k in self.keys}
        keys = [c for c in fields if c.lower() in own]
        bucket, spread, alone, t_, s_, count = free_names(keys, "_bucket", "_spread", "_alone", "t", "s", "_count")
        t, s, _ = load.sides(self._rows(found, list(found.segments)), fields)
        kinds = {"t": (t_, t.schema["t"].dataType), "s": (s_, s.schema["s"].dataType)}
        both = []
        for side, df in (("t", t), ("s", s)):
            values = [F.col(side)[c] for c in keys]
            null = reduce(lambda a, b: a | b, (v.isNull() for v in values))
            apart = F.when(null, F.concat(F.lit(side), F.monotonically_increasing_id().cast("string")))
            both.append(df.select(*(v.alias(c) for v, c in zip(values, keys, strict=True)), apart.alias(alone), *((F.col(x) if x == side else F.lit(None).cast(k)).alias(n) for x, (n, k) in kinds.items())))
        rows = both[0].unionByName(both[1])
        at, in_it, files = self._places(rows.select(*map(quoted, keys), alone), total)
        dealt = rows.withColumns({bucket: at, spread: in_it}).repartition(files, bucket, spread)
        one = lambda c: F.first(c, ignorenulls=True)
        met = dealt.groupBy(bucket, spread, *map(quoted, keys), alone).agg(one(t_).alias("t"), one(s_).alias("s"), F.count(s_).alias(count))
        seen = Observation()
        met = met.observe(seen, F.max(count).alias("most")).where(F.col("t").isNotNull() | F.lit(load.insert is not None))
        made = self._segments(met.select(*load.outcome(fields), bucket), bucket)
        if load.check and seen.get["most"] > 1:
            self._drop_folders({s.path.split("/")[0] for s in made})
            load.checked()
        return made

    def _changed(self, manifest: Manifest, rows: DataFrame, file: str, row: str) -> list[Segment] | None:
        """The segments of a version once rows have changed (file and row: where those were that
        it has already), None without any. Buckets that would have too many dead rows or
        segments are written anew with them."""
        fresh = rows.drop(file, row)
        more = {r[0]: r[1] for r in fresh.groupBy(self._bucket(fresh)).count().collect()}  # a row for each bucket
        if not more:
            return None
        marked = replace(manifest, segments=tuple(self._dead(manifest, rows, file, row)))
        by: dict[int, list[Segment]] = {}
        for s in marked.segments:
            by.setdefault(s.bucket, []).append(s)
        stale = {b for b, own in by.items() if len(own) + (b in more) > self.most_segments or sum(s.dead_rows for s in own) > self.dead_share * (sum(s.rows for s in own) + more.get(b, 0))}
        left = [s for s in marked.segments if s.bucket in stale and s.rows > s.dead_rows]
        if left:
            fresh = fresh.unionByName(self._rows(marked, left))
        made = self._store(fresh, sum(more.values()) + sum(s.rows - s.dead_rows for s in left))
        out = [*(s for s in marked.segments if s.bucket not in stale), *made]
        self._drop_folders(marked.folders() - manifest.folders() - replace(marked, segments=tuple(out)).folders())  # places of rewritten rows
        return out

    def _dead(self, found: Manifest, rows: DataFrame, file: str, row: str) -> list[Segment]:
        """The segments of a version, with the places of changed rows noted as dead."""
        holes = rows.where(F.col(file).isNotNull()).select(F.col(file).alias("file"), F.col(row).alias("row"), F.substring_index(file, "/", 1).cast("int").alias("bucket"))
        counts = {r[0]: r[1] for r in holes.groupBy("file").count().collect()}  # a row for each file
        if not counts:
            return list(found.segments)
        name = f"dead-{uuid.uuid4().hex}"
        holes.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        holed, out = {int(f.split("/")[0]) for f in counts}, []
        for s in found.segments:
            more = 0
            if s.bucket in holed:
                files, at = self._hadoop(f"{self.path}/{s.path}")
                more = sum(counts.get(f"{s.bucket}/{x.getPath().getName()}", 0) for x in files.listStatus(at))
            out.append(replace(s, dead=(*s.dead, f"{name}/bucket={s.bucket}"), dead_rows=s.dead_rows + more) if more else s)
        return out

    def drop(self) -> None:
        delete_folder(self.spark, self.path)

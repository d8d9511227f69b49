"""MERGE on DataFrames: keyed joins of a target's and a source's rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import delete_folder
from .tables import comparable, free_names

LINEAGE = ["landing_source_file", "ingestion_timestamp", "updated_source_file", "updated_timestamp"]

Rows = Callable[[str], Column]
Rule = Callable[[Rows, Rows], Column]


class DuplicateKeys(ValueError):
    """A key that several source rows have."""


def quoted(name: str) -> str:
    """A column's name as F.col takes it whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def _aligned(df: DataFrame, fields: dict[str, str], name: str) -> Column:
    """A struct of the fields; a column is found without regard to case, null if it is missing."""
    own = {c.lower(): c for c in df.columns}
    cols = [(F.col(quoted(own[c.lower()])) if c.lower() in own else F.lit(None)).cast(t).alias(c) for c, t in fields.items()]
    return F.struct(*cols).alias(name)


@dataclass(frozen=True)
class Merge:
    """What a load does to a table.

    Keys match by =, so null keys never do: such target rows stay and such source rows
    are inserted. update: new values of matched rows, "all" for the source's, where
    update_when holds; insert: values of new rows, "all" for the source's (other columns
    of a dict come from the source); not_matched: a condition and new values for target
    rows without a source row. Rules get two functions from a column's name to the
    target's and the source's value. The table's columns are those of either side, whose
    names differ in more than case, but for `hidden` ones, which only rules read; a side
    that lacks one has null there. Several source rows of one key raise DuplicateKeys if check.
    """

    source: DataFrame
    keys: list[str]
    update: dict[str, Rule] | str | None = "all"
    update_when: Rule | None = None
    insert: dict[str, Rule] | str | None = "all"
    not_matched: tuple[Rule, dict[str, Rule]] | None = None
    hidden: tuple[str, ...] = ()
    check: bool = True

    def fields(self, target: T.StructType | None) -> dict[str, str]:
        """Names and types of the merged table's columns."""
        out = {f.name: f.dataType.simpleString() for f in target or []}
        have = {c.lower() for c in (*out, *self.hidden)}
        return out | {f.name: f.dataType.simpleString() for f in self.source.schema if f.name.lower() not in have}

    def whole_keys(self) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & F.col(quoted(k)).isNotNull()
        return out

    def checked(self) -> None:
        if self.check:
            twice = self.source.where(self.whole_keys()).groupBy(*map(quoted, self.keys)).count().where("count > 1").limit(1).collect()
            if twice:
                raise DuplicateKeys(f"several source rows have the key {tuple(twice[0])[:-1]}")

    def sides(self, target: DataFrame, fields: dict[str, str], *more: str) -> tuple[DataFrame, DataFrame, Column]:
        """Target rows as a struct t (with the columns `more` beside it), source rows as a
        struct s, and the condition under which they match."""
        seen = fields | {f.name: f.dataType.simpleString() for f in self.source.schema if f.name in self.hidden}
        on = F.lit(True)
        for k in self.keys:
            on = on & (F.col("t")[k] == F.col("s")[k])
        return target.select(*more, _aligned(target, fields, "t")), self.source.select(_aligned(self.source, seen, "s")), on

    @staticmethod
    def _values() -> tuple[Rows, Rows]:
        return (lambda c: F.col("t")[c]), (lambda c: F.col("s")[c])

    def updates(self) -> Column:
        """Whether a matched row changes."""
        if not self.update:
            return F.lit(False)
        return F.coalesce(self.update_when(*self._values()), F.lit(False)) if self.update_when else F.lit(True)

    def closes(self) -> Column:
        """Whether a target row without a source row changes."""
        return F.coalesce(self.not_matched[0](*self._values()), F.lit(False)) if self.not_matched else F.lit(False)

    def _ruled(self, rules: dict[str, Rule] | str | None, c: str, kind: str) -> Column | None:
        old, new = self._values()
        if isinstance(rules, dict):
            rule = {k.lower(): r for k, r in rules.items()}.get(c.lower())
            return rule(old, new).cast(kind) if rule else None
        return new(c) if rules == "all" else None

    def updated(self, c: str, kind: str) -> Column:
        value = self._ruled(self.update, c, kind)
        return self._values()[0](c) if value is None else value

    def inserted(self, c: str, kind: str) -> Column:
        value = self._ruled(self.insert, c, kind)
        return self._values()[1](c) if value is None else value

    def closed(self, c: str, kind: str) -> Column:
        value = self._ruled(self.not_matched and self.not_matched[1], c, kind)
        return self._values()[0](c) if value is None else value

    def changes(self) -> Column:
        """Whether a row of the outer join of both sides is new or changes."""
        has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
        return ~has_t | (has_s & self.updates()) | (~has_s & self.closes())

    def outcome(self, fields: dict[str, str]) -> list[Column]:
        """The columns of the table after the merge, of a row of the outer join of both sides."""
        has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
        out = []
        for c, kind in fields.items():
            value = F.when(~has_t, self.inserted(c, kind)).when(has_t & has_s & self.updates(), self.updated(c, kind))
            if self.not_matched:
                value = value.when(has_t & ~has_s & self.closes(), self.closed(c, kind))
            out.append(value.otherwise(F.col("t")[c]).cast(kind).alias(c))
        return out

    def applied(self, target: DataFrame | None) -> DataFrame:
        """All rows of the table after the merge; None: a table without rows."""
        fields = self.fields(target.schema if target is not None else None)
        if target is not None:
            self.checked()
        else:
            target = self.source.select(*map(quoted, self.source.columns)).where("false")
        t, s, on = self.sides(target, fields)
        met = t.join(s, on, "full_outer" if self.insert is not None else "left")
        return met.select(*self.outcome(fields))


def merge_df(target: DataFrame, source: DataFrame, keys: list[str], **rules: object) -> DataFrame:
    """The target after a merge of the source; rules as those of Merge."""
    return Merge(source, keys, **rules).applied(target)


def lineage_merge(source: DataFrame, keys: list[str], now: Column) -> Merge:
    """Updates a row only if a column other than keys and lineage differs; keeps the first
    landing file and ingestion time, and stamps the update's. New rows have no update."""
    empty = {"updated_source_file": F.lit(None).cast("string"), "updated_timestamp": F.lit(None).cast("timestamp_ntz")}
    rows = source.withColumns(empty)
    values = [c for c in rows.columns if c not in keys and c not in LINEAGE]
    kinds = {f.name: f.dataType for f in rows.schema}

    def differs(old: Rows, new: Rows) -> Column:
        out = F.lit(False)
        for c in values:
            out = out | ~comparable(old(c), kinds[c]).eqNullSafe(comparable(new(c), kinds[c]))
        return out

    update: dict[str, Rule] = {c: (lambda old, new, c=c: new(c)) for c in values}
    update["updated_source_file"] = lambda old, new: new("landing_source_file")
    update["updated_timestamp"] = lambda old, new: now
    return Merge(rows, keys, update=update, update_when=differs)


def merge_with_lineage(target: DataFrame | None, source: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The target after lineage_merge."""
    return lineage_merge(source, keys, now).applied(target)


def upsert_merge(source: DataFrame, keys: list[str], now: Column) -> Merge:
    """All columns of matched rows from the source, and new rows, stamped with the update."""
    return Merge(source.withColumns({"updated_source_file": F.col("landing_source_file"), "updated_timestamp": now}), keys)


def upsert(target: DataFrame | None, source: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The target after upsert_merge."""
    return upsert_merge(source, keys, now).applied(target)


def latest_ingestion(feed: DataFrame) -> DataFrame:
    """(latest_ingestion), one row: when the feed's last rows came in; null if it is empty."""
    return feed.agg(F.max("ingestion_timestamp").alias("latest_ingestion"))


def close_missing(target: DataFrame, current: DataFrame, key: str, latest: Column, now: Column) -> DataFrame:
    """Ends the open rows whose key isn't in the current snapshot and which were ingested
    before it: end_timestamp becomes the snapshot's time."""
    (mark,) = free_names(target, "current")
    met = target.join(current.select(key).distinct().withColumn(mark, F.lit(True)).hint("merge"), key, "left")
    gone = F.col(mark).isNull() & F.col("end_timestamp").isNull() & (F.col("ingestion_timestamp") < latest)
    changes = {"end_timestamp": F.when(gone, latest).otherwise(F.col("end_timestamp")), "updated_timestamp": F.when(gone, now).otherwise(F.col("updated_timestamp"))}
    return met.withColumns(changes).select(*target.columns)


def snapshot_merge(source: DataFrame, current: DataFrame, key: str, latest: Column, now: Column) -> Merge:
    """An upsert of all rows ever seen (source) and the closure of those that the current
    snapshot lacks, in one merge. A row of the snapshot is as the source says, open again
    if it says so. Another one that has no end of its own keeps the end that it was closed
    with, or is closed at `latest`, the snapshot's time, if it was ingested before. So a
    closure lasts, and its time doesn't move, until the feed brings the row back."""
    rows = upsert_merge(source, [key], now).source
    (mark,) = free_names(rows, "current")
    rows = rows.join(current.select(key).distinct().withColumn(mark, F.lit(True)).hint("merge"), key, "left")  # keys of unknown size aren't broadcast
    closing = lambda side: F.when(side("ingestion_timestamp") < latest, latest)

    def end(old: Rows, new: Rows) -> Column:
        return F.when(new(mark), new("end_timestamp")).otherwise(F.coalesce(new("end_timestamp"), old("end_timestamp"), closing(new)))

    update: dict[str, Rule] = {c: (lambda old, new, c=c: new(c)) for c in rows.columns if c != mark}
    missing = lambda old, new: old("end_timestamp").isNull() & (old("ingestion_timestamp") < latest)
    return Merge(rows, [key], update=update | {"end_timestamp": end}, insert={"end_timestamp": end}, not_matched=(missing, {"end_timestamp": lambda old, new: latest}), hidden=(mark,))


def merge_snapshot(target: DataFrame | None, source: DataFrame, current: DataFrame, key: str, latest: Column, now: Column) -> DataFrame:
    """The target after snapshot_merge."""
    return snapshot_merge(source, current, key, latest, now).applied(target)


def presence_merge(source: DataFrame, gone: DataFrame, key: str, now: Column) -> Merge:
    """As snapshot_merge, from (key, gone_at): when the first snapshot after the last one
    that has the row was taken, null if that is the last of all. However many snapshots
    came in at once, a row ends when the first of them that lacks it was taken."""
    rows = upsert_merge(source, [key], now).source
    (mark,) = free_names(rows, "gone_at")
    rows = rows.join(gone.select(F.col(key), F.col("gone_at").alias(mark)).hint("merge"), key, "left")
    end = lambda old, new: F.coalesce(new("end_timestamp"), new(mark))
    update: dict[str, Rule] = {c: (lambda old, new, c=c: new(c)) for c in rows.columns if c != mark}
    return Merge(rows, [key], update=update | {"end_timestamp": end}, insert={"end_timestamp": end}, hidden=(mark,))


class VersionedTable:
    """A Parquet table as a folder of versions. A version counts once its write has
    ended, so readers see the old one until then; the path that is read is never written.
    The last `keep` versions stay. Of two writers that start from one version, one fails:
    a version is never overwritten. name: the table's name in the catalog (database.table),
    under which spark.table and SQL read the last version."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, name: str | None = None):
        self.spark, self.path, self.keep, self.name = spark, path.rstrip("/"), keep, name

    def _publish(self, version: int) -> None:
        """Points the catalog's table at a version. A table of the same columns is moved, so
        readers find one all the time; another one is declared anew."""
        name = ".".join(map(quoted, self.name.split(".")))
        if "." in self.name:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rpartition('.')[0]}")
        at = f"{self.path}/v{version}"
        if self.spark.catalog.tableExists(self.name):
            if self.spark.table(name).schema == self.spark.read.parquet(at).schema:
                self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{at}'")
                self.spark.catalog.refreshTable(name)
                return
            self.spark.sql(f"DROP TABLE {name}")  # its files are the folder's own and stay
        self.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{at}'")

    def _folders(self) -> list[tuple[int, bool]]:
        """Version numbers in order, and whether each was written to its end."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath() for s in files.listStatus(path)]
        return sorted((int(p.getName()[1:]), files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))) for p in names if p.getName().startswith("v"))

    def _versions(self) -> list[int]:
        return [v for v, whole in self._folders() if whole]

    def read(self) -> DataFrame | None:
        """The last whole version, None if there is none."""
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def create(self, schema: str) -> bool:
        """An empty table of the schema, if there is no table yet; whether it was made."""
        if self._versions():
            return False
        self.write(self.spark.createDataFrame([], schema))
        return True

    def write(self, df: DataFrame) -> int:
        found = self._folders()
        version = found[-1][0] + 1 if found else 0  # not that of a write that broke off either
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.path}/v{version}")
        if self.name:
            self._publish(version)
        kept = [v for v, whole in found if whole][-(self.keep - 1) :] if self.keep > 1 else []
        for old, _ in found:
            if old < min(kept, default=version):
                delete_folder(self.spark, f"{self.path}/v{old}")
        return version

    def merge(self, source: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
        """Writes merge(target, source) as the next version; an empty source changes nothing."""
        if source.isEmpty():
            return (self._versions() or [-1])[-1]
        return self.write(merge(self.read(), source))

    def drop(self) -> None:
        if self.name and self.spark.catalog.tableExists(self.name):
            self.spark.sql(f"DROP TABLE {'.'.join(map(quoted, self.name.split('.')))}")
        delete_folder(self.spark, self.path)

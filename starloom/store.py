"""The canon as versioned Parquet: numbered manifests name the folders of each table, and the newest manifest counts.

An import writes its tables to new folders and then the next manifest, which is created only if no other import has
created that number. One that comes second looks at what the first has changed: if it has read none of it, its own
changes are put on top; else it builds them anew from the newer canon. So imports may run at once, none is lost, and each
manifest is the outcome of all before it, one after the other. Until its manifest stands, nothing of an import is seen.

Files go through Hadoop's file system. A manifest is made by a rename that fails where the name exists, which is one
step on HDFS, and on a local disk by a link; an object store without either needs its own committer in between.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import FK_TO_ARTIST, ORDERS, PARTS, TABLES

LEDGER = "dump_import"
WHOLE = ""  # the part of a table that isn't kept in parts
REBUILDS = 5
#: Size of a row group in sorted tables: what one look-up reads.
ROW_GROUP = 8 << 20

#: table -> part -> order -> folder
Entries = dict[str, dict[str, dict[str, str]]]


class Conflict(RuntimeError):
    """Other imports changed what this one reads, again and again."""


class Snapshot:
    """The canon as one manifest has it. It remembers what was read from it."""

    def __init__(self, canon: Canon, number: int, entries: Entries):
        self.canon, self.number, self.entries, self.used = canon, number, entries, set()

    def folders(self, table: str, part: object = None, by: str | None = None) -> list[str]:
        """Folders of a table or of one of its parts, sorted by `by` where such a copy is kept."""
        self.used.add((table, None if part is None else str(part)))
        parts = self.entries.get(table, {})
        return [copies.get(by) or next(iter(copies.values())) for p, copies in sorted(parts.items()) if part is None or p == str(part)]

    def read(self, table: str, part: object = None, by: str | None = None) -> DataFrame:
        paths = [f"{self.canon.root}/{f}" for f in self.folders(table, part, by)]
        spark = self.canon.spark
        return spark.read.parquet(*paths) if paths else spark.createDataFrame([], TABLES[table][0])


class Canon:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.counters: dict[str, int] = {}  # of the last import: what it read, kept and passed over
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """(name, time of change) of what is in a folder of the canon."""
        path = self._path(f"{self.root}/{folder}")
        return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name, _ in self._listed("manifests") if name.endswith(".json"))

    def _entries(self, number: int) -> Entries:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, number: int, entries: Entries) -> bool:
        """Write a manifest under its number; false, and nothing done, if there is one already."""
        draft, target = self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.draft"), self._path(f"{self.root}/manifests/{number:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(entries), "utf-8"))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                fs = self._jvm.org.apache.hadoop.fs
                whole = [self._fs.makeQualified(p) for p in (draft, target)]
                how = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
                fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(*whole, how)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getSimpleName().startswith("FileAlreadyExists"):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def snapshot(self) -> Snapshot:
        while True:
            number = max(self._numbers(), default=0)
            try:
                return Snapshot(self, number, self._entries(number) if number else {})
            except Py4JJavaError:  # a vacuum took it between the two steps, so there is a newer one
                if number in self._numbers():
                    raise

    def manifest(self) -> Entries:
        return self.snapshot().entries

    def read(self, table: str, part: object = None, by: str | None = None) -> DataFrame:
        return self.snapshot().read(table, part, by)

    def update(self, source: str, version: str, build: Callable[[Snapshot], dict], emptied: list[str] = ()) -> int:
        """Enter an import; returns the rows written. build(snapshot) gives the new tables by name, or by (name, part)
        for one part of a table; it is called again if another import has meanwhile changed what it read. `emptied` of
        ["*"] empties every table that refers to artists, as a new backbone does."""
        started = datetime.now(timezone.utc)
        gone = [t for t, _ in FK_TO_ARTIST] if list(emptied) == ["*"] else list(emptied)
        for _ in range(REBUILDS):
            at = self.snapshot()
            added, rows = self._written(build(at), f"data/{source.replace(' ', '-')}-{uuid.uuid4().hex[:12]}")
            base = at
            while not changed(at.entries, base.entries, at.used):
                entries = {t: dict(parts) for t, parts in base.entries.items() if t not in gone}
                for (table, part), copies in added.items():
                    entries[table] = {**(entries.get(table, {}) if part != WHOLE else {}), part: copies}
                entries[LEDGER] = {WHOLE: {"": self._entered(base, source, version, started, rows)}}
                if self._create(base.number + 1, entries):
                    return rows
                base = self.snapshot()
        raise Conflict(f"{source} {version}: other imports changed what it reads {REBUILDS} times")

    def replace(self, tables: dict, source: str, version: str, emptied: list[str] = ()) -> int:
        """update() with tables that don't depend on the canon."""
        return self.update(source, version, lambda _: tables, emptied)

    def _written(self, tables: dict, folder: str) -> tuple[dict[tuple[str, str], dict[str, str]], int]:
        """Write tables, a copy for each order they are kept in; ((table, part) -> order -> folder, rows)."""
        added, rows = {}, 0
        for key, df in tables.items():
            table, part = key if isinstance(key, tuple) else (key, WHOLE)
            if table in PARTS and part == WHOLE:
                raise ValueError(f"{table} is replaced by its {PARTS[table]}")
            copies = {}
            for order in ORDERS.get(table, [""]):
                path = "/".join(x for x in (folder, table, str(part), order) if x)
                laid = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
                laid.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/{path}")
                copies[order] = path
            added[table, str(part)] = copies
            rows += self.spark.read.parquet(f"{self.root}/{next(iter(copies.values()))}").count()
        return added, rows

    def _entered(self, base: Snapshot, source: str, version: str, started: datetime, rows: int) -> str:
        """Folder of the ledger with this import's line; an import of the same source and version keeps its number."""
        old = Snapshot(self, base.number, base.entries).read(LEDGER)
        same = (F.col("source") == source) & (F.col("version") == version)
        number = (old.where(same).select("id").first() or old.agg(F.coalesce(F.max("id") + 1, F.lit(1))).first())[0]
        line = self.spark.createDataFrame([(number, source, version, started, datetime.now(timezone.utc), rows)], TABLES[LEDGER][0])
        path = f"data/ledger-{uuid.uuid4().hex[:12]}"
        old.where(~same).unionByName(line).write.parquet(f"{self.root}/{path}")
        return path

    def imported(self, source: str, version: str) -> bool:
        return not self.read(LEDGER).where((F.col("source") == source) & (F.col("version") == version)).isEmpty()

    def vacuum(self, keep: int = 10, grace_hours: float = 24) -> list[str]:
        """Delete all but the newest manifests, and data folders that none of those names; returns the folders. What is
        younger than the grace time stays, as an import that is still running may have written it."""
        numbers, limit = self._numbers(), time.time() - grace_hours * 3600
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{n:012d}.json"), False)
        named = {f.split("/")[1] for n in numbers[-keep:] for parts in self._entries(n).values() for copies in parts.values() for f in copies.values()}
        out = [name for name, changed_at in self._listed("data") if name not in named and changed_at < limit]
        for name in out:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        for name, changed_at in self._listed("manifests"):
            if name.endswith(".draft") and changed_at < limit:
                self._fs.delete(self._path(f"{self.root}/manifests/{name}"), False)
        return out


def changed(old: Entries, new: Entries, used: set[tuple[str, str | None]]) -> bool:
    """Whether anything of `used` (tables, or parts of them) differs between two manifests."""
    part_of = lambda entries, table, part: entries.get(table, {}) if part is None else entries.get(table, {}).get(part)
    return any(part_of(old, *u) != part_of(new, *u) for u in used)


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the first by `order`."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def merged(old: DataFrame, new: DataFrame, key: list[str], total: str) -> DataFrame:
    """Upsert that adds: rows of both, `total` summed where keys meet."""
    return old.unionByName(new).groupBy(*key).agg(F.sum(total).alias(total))


def numbered(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(id, key): known keys keep their number; new ones follow the greatest, in order. For small registries such as
    metrics and layouts."""
    from pyspark.sql import Window

    fresh = keys.select(key).distinct().join(old, key, "left_anti")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = fresh.join(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy(key))).cast("int").alias("id"), key)
    return old.select("id", key).unionByName(fresh)

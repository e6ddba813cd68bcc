"""Tables that are changed in place: Parquet dealt into buckets by key, each version a manifest.

A change reads and rewrites only the buckets that its keys fall into. New files go to a folder of their own and
count only once a manifest names them; a manifest is put in place by one rename that never replaces another. So a
reader sees a version whole or not at all, a writer that dies leaves the last version as it was, and of two
writers that start from one version the second one either goes on top (other buckets) or is told to try again.

``path/data/<write>/bucket=<k>/`` holds files, ``path/manifest/<version>.json`` names the write of every bucket.
Number the buckets so that one is some hundred megabytes at most: it is the least that a change writes. ``grow``
deals the table into more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import lineage, writes

# Versions that stay readable after a change.
KEPT = 2
# Bucket column of the stored files.
BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since this one began."""


class _Files:
    """Small files and folders on the store of a path, through Spark's own configuration."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.gateway, self.jvm = context._gateway, context._jvm
        at = self._path(path)
        self.fs = at.getFileSystem(context._jsc.hadoopConfiguration())
        uri = self.fs.makeQualified(at).toUri()
        self.renamer = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, context._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder with their times of change in milliseconds; none if it is not there."""
        at = self._path(folder)
        if not self.fs.exists(at):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at)]

    def text(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def place(self, path: str, text: str) -> bool:
        """Put a file in place whole, unless there is one."""
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.renamer.rename(self._path(draft), self._path(path), options)
            return True
        except Exception:
            self.remove(draft)
            if self.fs.exists(self._path(path)):
                return False
            raise

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class BucketTable:
    """A table at ``path`` that is read whole and changed by key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark, self.path)

    # -- versions ------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int) -> BucketTable:
        """An empty table, unless there is one already."""
        if BUCKET in schema.names:
            raise ValueError(f"a column may not be named {BUCKET}")
        table = cls(spark, path)
        first = {"keys": list(keys), "buckets": buckets, "schema": json.loads(schema.json()), "writes": {}, "tags": {}}
        if not table.versions():
            table.files.place(table._manifest(0), json.dumps(first))
        return table

    @classmethod
    def store(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> BucketTable:
        """A new table with these rows."""
        table = cls.create(df.sparkSession, path, df.schema, keys, buckets)
        table.overwrite(df)
        return table

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self.files.names(f"{self.path}/manifest") if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        version = max(self.versions()) if version is None else version
        return version, json.loads(self.files.text(self._manifest(version)))

    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest()[1]["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        return self._read(self.manifest(version)[1], None)

    def _read(self, manifest: dict, only: set[int] | None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        places = [f"{self.path}/data/{write}/{BUCKET}={k}" for k, write in manifest["writes"].items() if only is None or int(k) in only]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    # -- changes -------------------------------------------------------------------------------

    def change(
        self,
        source: DataFrame,
        apply: Callable[[DataFrame, DataFrame], DataFrame],
        tag: tuple[str, int] | None = None,
        attempts: int = 5,
    ) -> int:
        """Replace the buckets of the source's keys by ``apply(their rows, source)``; gives the version.

        ``apply`` must keep every row in the bucket of its key. A ``tag`` (who, number) makes a
        change count once: it is left out if that number or a later one of the same writer is in the table.
        """
        for _ in range(attempts):
            version, manifest = self.manifest()
            if tag and manifest["tags"].get(tag[0], -1) >= tag[1]:
                return version
            bucket = self._bucket(manifest)
            # At most as many numbers as the table has buckets.
            touched = {r[0] for r in source.select(bucket.alias(BUCKET)).distinct().toLocalIterator()}
            rows = apply(self._read(manifest, touched), source)
            try:
                return self._commit(version, manifest, touched, rows, tag)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: gave up after {attempts} attempts")

    def overwrite(self, rows: DataFrame, tag: tuple[str, int] | None = None) -> int:
        """Replace the whole table."""
        version, manifest = self.manifest()
        return self._commit(version, manifest, set(range(manifest["buckets"])), rows, tag)

    @staticmethod
    def _bucket(manifest: dict) -> Column:
        # Hashes depend on the type, so a source's keys are taken as the table's.
        schema = StructType.fromJson(manifest["schema"])
        keys = [F.col(k).cast(schema[k].dataType) for k in manifest["keys"]]
        return F.pmod(F.xxhash64(*keys), F.lit(manifest["buckets"])).cast("int")

    def _commit(self, version: int, manifest: dict, touched: set[int], rows: DataFrame, tag) -> int:
        write = uuid.uuid4().hex
        typed = [F.col(f.name).cast(f.dataType) for f in StructType.fromJson(manifest["schema"])]
        placed = rows.select(*typed).withColumn(BUCKET, self._bucket(manifest))
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{write}")
        filled = {int(n.split("=")[1]) for n, _ in self.files.names(f"{self.path}/data/{write}") if n.startswith(f"{BUCKET}=")}
        if not filled <= touched:
            raise ValueError("a changed row left the buckets of the change")
        began, old = version, manifest["writes"]
        while True:
            kept = {k: w for k, w in manifest["writes"].items() if int(k) not in touched}
            new = manifest | {"writes": kept | {str(k): write for k in sorted(filled)}}
            if tag:
                new["tags"] = manifest["tags"] | {tag[0]: tag[1]}
            if self.files.place(self._manifest(version + 1), json.dumps(new)):
                self._forget(version + 1, new)
                return version + 1
            # Somebody was faster: go on top of them if they left these buckets alone.
            version, manifest = self.manifest()
            moved = any(manifest["writes"].get(str(k)) != old.get(str(k)) for k in touched)
            if moved or manifest["buckets"] != new["buckets"] or (tag and manifest["tags"].get(tag[0], -1) >= tag[1]):
                self.files.remove(f"{self.path}/data/{write}")
                raise Conflict(f"{self.path}: version {began} is no longer the last one")

    def _forget(self, newest: int, manifest: dict) -> None:
        """Remove versions beyond the kept ones, and the files that only they name."""
        versions = self.versions()
        gone, kept = [v for v in versions if v <= newest - KEPT], [v for v in versions if v > newest - KEPT]
        if not gone:
            return
        named = {w for v in kept for w in self.manifest(v)[1]["writes"].values()} | set(manifest["writes"].values())
        old = {w for v in gone for w in self.manifest(v)[1]["writes"].items()}
        live = {(k, w) for v in kept for k, w in self.manifest(v)[1]["writes"].items()} | set(manifest["writes"].items())
        for k, w in old - live:
            self.files.remove(f"{self.path}/data/{w}/{BUCKET}={k}" if w in named else f"{self.path}/data/{w}")
        for v in gone:
            self.files.remove(self._manifest(v))

    def sweep(self, older_than_hours: float = 24) -> list[str]:
        """Remove the files of writers that died, once nobody can still be writing them."""
        named = {w for v in self.versions() for w in self.manifest(v)[1]["writes"].values()}
        found = self.files.names(f"{self.path}/data")
        newest = self.spark.sparkContext._jvm.System.currentTimeMillis()
        dead = [n for n, t in found if n not in named and newest - t >= older_than_hours * 3_600_000]
        for n in dead:
            self.files.remove(f"{self.path}/data/{n}")
        return dead

    def grow(self, buckets: int) -> int:
        """Deal the table into another number of buckets."""
        version, manifest = self.manifest()
        rows = self._read(manifest, None)
        return self._commit(version, manifest | {"buckets": buckets}, set(range(max(buckets, manifest["buckets"]))), rows, None)

    # -- keyed writes ----------------------------------------------------------------------------

    def keys(self) -> list[str]:
        return self.manifest()[1]["keys"]

    def upsert(self, source: DataFrame, update: Sequence[str], tag: tuple[str, int] | None = None) -> int:
        """Insert new keys, overwrite the ``update`` columns of known ones."""
        return self.change(source, lambda old, new: writes.upsert(old, new, self.keys(), update), tag)

    def patch(self, source: DataFrame, columns: Sequence[str], tag: tuple[str, int] | None = None) -> int:
        """Overwrite columns of known keys."""
        return self.change(source, lambda old, new: writes.patch(old, new, self.keys(), columns), tag)

    def fill_blanks(self, source: DataFrame, columns: Sequence[str], longer: Sequence[str] = ()) -> int:
        """Take values only where known keys have none (``longer`` columns: the longer text)."""
        return self.change(source, lambda old, new: writes.fill_blanks(old, new, self.keys(), columns, longer))

    def replace_children(self, parents: DataFrame, new_rows: DataFrame) -> int:
        """Put new rows in the place of all rows of the listed parents; the table's one key is the parent."""
        (key,) = self.keys()
        listed = parents.select(key).unionByName(new_rows.select(key)).distinct()
        return self.change(listed, lambda old, some: writes.replace_children(old, parents, new_rows, key))

    def delete(self, doomed: DataFrame) -> int:
        """Drop rows by key."""
        keys = self.keys()
        return self.change(doomed.select(*keys).distinct(), lambda old, gone: old.join(gone, keys, "left_anti"))

    def toggle(self, presses: DataFrame) -> int:
        """Keys that are there go and keys that are not come, for keys pressed an odd number of times."""
        keys = self.keys()
        return self.change(presses.select(*keys), lambda old, new: writes.toggle(old, new, keys))


def cascade_delete(tables: dict[str, BucketTable], root: str, doomed: DataFrame, links: Sequence[tuple[str, str, str, str, str]]) -> dict[str, int]:
    """Delete root rows and follow foreign keys down, each table rewritten only where it loses or changes rows.

    ``links`` are (child, child column, parent, parent key, action) in parent-first order; the action is
    ``cascade`` or ``null``. Children go before their parents, so a run that dies halfway leaves no
    row without its parent and may simply be run again.
    """
    keys = tables[root].keys()
    gone = {root: lineage.cut(tables[root].read().join(doomed.select(*keys).distinct(), keys, "left_semi"))}
    cleared: list[tuple[str, DataFrame, str]] = []
    for child, column, parent, parent_key, action in links:
        over = gone[parent].select(F.col(parent_key).alias(column)).distinct()
        hit = lineage.cut(tables[child].read().join(over, column, "left_semi"))
        if action == "null":
            cleared.append((child, hit.withColumn(column, F.lit(None).cast(hit.schema[column].dataType)), column))
        else:
            gone[child] = gone[child].unionByName(hit) if child in gone else hit
    done = {}
    for child, rows, column in cleared:
        done[child] = tables[child].patch(rows, [column])
    for name in reversed(gone):
        done[name] = tables[name].delete(gone[name])
    return done

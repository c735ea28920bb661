"""The collection: deterministic ids, upserts, versioned replacement, deletion, snapshots.

A collection is Parquet files in hash buckets and a manifest per version, which names the files of each bucket. A change
writes new files for the buckets it touches, then publishes the next manifest, so readers see all or nothing and other
buckets' files are shared between versions.
"""

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isopleth.sources.store import Store

#: Fixed value: the namespace of URLs in RFC 4122.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(key: Column) -> Column:
    """Name-based UUID (version 5) of a string in the namespace of URLs."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(key, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def upsert_latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the highest version."""
    order = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in version))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def versioned_swap(rows: DataFrame, source: str, run: str) -> DataFrame:
    """Rows of each source's last run; rows without a run belong to none and go once a run exists."""
    last = rows.groupBy(F.col(source).alias("_s")).agg(F.max(run).alias("_run"))
    return rows.join(last, rows[source] == last["_s"]).where(F.col("_run").isNull() | (F.col(run) == F.col("_run"))).select(*rows.columns)


def delete_where(rows: DataFrame, source: str, value, but_run: tuple[str, object] | None = None) -> DataFrame:
    """Rows without those of a source, or without those of a source that are of another run (or of none)."""
    hit = F.col(source) == F.lit(value)
    if but_run:
        hit = hit & ~F.col(but_run[0]).eqNullSafe(F.lit(but_run[1]))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with some columns replaced where a condition holds."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


class Collection:
    """A table of rows with a key, in buckets, with versions.

    A row's bucket comes from a hash of its key. With `group`, a column that the key determines (as a chunk's source),
    each group lives in `spread` of the buckets, so to replace a group touches those alone, and a hot group is still
    spread over that many. The layout is fixed by the first version. Versions are numbered; publishing a number that is
    taken fails, and the change is then tried again on the version that took it: as it is if that one touched other
    buckets, from the start otherwise. The driver holds a manifest: some paths per bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = ("id",), group: str | None = None, buckets: int = 64, spread: int = 8):
        self.spark, self.folder, self.store = spark, folder.rstrip("/"), Store(spark, folder)
        if buckets % spread:
            raise ValueError("buckets must be a multiple of spread")
        self.layout = {"key": list(key), "group": group, "buckets": buckets, "spread": spread}
        if self.versions():
            self.layout = self.manifest()["layout"]

    def versions(self) -> list[str]:
        """Published versions, oldest first; the last is the current one."""
        return sorted(name[: -len(".json")] for name in self.store.list(f"{self.folder}/manifests") if name.endswith(".json") and not name.startswith("."))

    def manifest(self, version: str | None = None) -> dict | None:
        """layout, schema, paths of each bucket, buckets that changed, last batch of each stream."""
        versions = [version] if version else self.versions()
        return json.loads(self.store.read_text(f"{self.folder}/manifests/{versions[-1]}.json")) if versions else None

    def bucket(self) -> Column:
        """The bucket of a row. Text and numbers of equal value differ, so a key's type must stay."""
        spread, key = self.layout["spread"], F.xxhash64(*map(F.col, self.layout["key"]))
        if self.layout["group"] is None:
            return F.pmod(key, F.lit(self.layout["buckets"])).cast("int")
        groups = self.layout["buckets"] // spread
        return (F.pmod(F.xxhash64(self.layout["group"]), F.lit(groups)) * spread + F.pmod(key, F.lit(spread))).cast("int")

    def _rows(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/data/{p}" for b, found in manifest["paths"].items() if buckets is None or b in buckets for p in found]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: str | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def lookup(self, keys: DataFrame, version: str | None = None) -> DataFrame:
        """Rows with the given keys (a frame of the key's columns and the group's), of the keys' buckets alone."""
        found = {str(r[0]) for r in keys.select(self.bucket()).distinct().collect()}
        return self._rows(self.manifest(version), found).join(keys.select(*self.layout["key"]).distinct(), self.layout["key"], "left_semi")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows by bucket; gives the new folder of each bucket that has any."""
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
        return {d.split("=")[1]: [f"{name}/{d}"] for d in self.store.list(f"{self.folder}/data/{name}") if d.startswith("_bucket=")}

    def _publish(self, number: int, manifest: dict) -> str | None:
        version = f"{number:012d}"
        return version if self.store.write_new(f"{self.folder}/manifests/{version}.json", json.dumps(manifest)) else None

    def _change(self, make, batch: tuple[str, int] | None = None) -> str:
        """make(manifest) gives (schema, paths of the touched buckets); publishes them on top of the current version."""
        done, first = None, None
        while True:
            versions = self.versions()
            base = self.manifest(versions[-1]) if versions else None
            if batch and base and base["batches"].get(batch[0], -1) >= batch[1]:
                return versions[-1]
            if done:
                since = set().union(*(self.manifest(v)["changed"] for v in versions if v > first))
                if since & set(done[1]) or base["schema"] != before["schema"]:
                    done = None
            if not done:
                first, before, done = versions[-1] if versions else "", base, make(base)
            schema, touched = done
            kept = {b: p for b, p in (base["paths"] if base else {}).items() if b not in touched}
            manifest = {
                "layout": self.layout, "schema": json.loads(schema.json()), "paths": kept | {b: p for b, p in touched.items() if p}, "changed": sorted(touched), "batches": (base["batches"] if base else {}) | ({batch[0]: batch[1]} if batch else {}),
            }
            version = self._publish(int(versions[-1]) + 1 if versions else 0, manifest)
            if version:
                return version

    def commit(self, rows: DataFrame) -> str:
        """All rows as a new version, in place of what there was."""
        new = self._write(rows)
        return self._change(lambda base: (rows.schema, {b: [] for b in (base["paths"] if base else {})} | new))

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> str:
        """Adds rows, whatever their keys. A batch (stream, number) that an earlier version has is not added again."""
        if batch and self._has(batch):
            return self.versions()[-1]
        new = self._write(rows)
        return self._change(lambda base: (self._wider(base, rows), {b: (base["paths"].get(b, []) if base else []) + p for b, p in new.items()}), batch)

    def upsert(self, rows: DataFrame, key: list[str] | None = None, vector: str | None = None, size: int | None = None, order: list[str] = (), batch: tuple[str, int] | None = None) -> str:
        """Replaces rows of equal key and adds the others; of equal new keys the one that is last by `order`.

        New rows are written once; of the buckets that they fall into, only rows that stay are written again. A vector of
        another size is refused. A batch (stream, number) that an earlier version has is not written again.
        """
        if key and list(key) != self.layout["key"]:
            if self.versions():
                raise ValueError(f"the key is {self.layout['key']}")
            self.layout["key"] = list(key)
        return self._merge(rows, None, vector, size, order, batch)

    def replace(self, column: str, value, rows: DataFrame, batch: tuple[str, int] | None = None, unless_empty: bool = False) -> str:
        """Upserts rows, and deletes the others whose column has the value; one version.

        unless_empty: without any new row all stays as it is.
        """
        return self._merge(rows, F.coalesce(F.col(column) == F.lit(value), F.lit(False)), None, None, (), batch, (column, value), unless_empty)

    def delete(self, condition: Column) -> str:
        """Deletes rows where a condition holds; only buckets that have such rows are written again."""
        return self._rewrite(condition, lambda rows: rows.where(~F.coalesce(condition, F.lit(False))))

    def update(self, condition: Column, values: dict[str, Column]) -> str:
        """Replaces some columns where a condition holds, not the key's or the group's."""
        if set(values) & {*self.layout["key"], self.layout["group"]}:
            raise ValueError("a row can't change its bucket")
        return self._rewrite(condition, lambda rows: update_where(rows, condition, values))

    def restore(self, version: str) -> str:
        """Makes an earlier version's rows the current ones, as a new version."""
        old = self.manifest(version)
        return self._change(lambda base: (StructType.fromJson(old["schema"]), {b: [] for b in base["paths"]} | old["paths"]))

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> int:
        """Deletes all but the last versions, and files that no version names; gives the number of folders deleted.

        Files younger than `grace` seconds stay, as a change that isn't published yet may need them.
        """
        versions = self.versions()
        for version in versions[:-keep]:
            self.store.delete(f"{self.folder}/manifests/{version}.json")
        named = {p for v in versions[-keep:] for found in self.manifest(v)["paths"].values() for p in found}
        deleted, before = 0, time.time() - grace
        for name, changed in self.store.list(f"{self.folder}/data", times=True):
            if changed > before:
                continue
            there = [d for d in self.store.list(f"{self.folder}/data/{name}") if d.startswith("_bucket=")]
            gone = [d for d in there if f"{name}/{d}" not in named]
            for d in gone if len(gone) < len(there) else ():
                self.store.delete(f"{self.folder}/data/{name}/{d}")
            if len(gone) == len(there):
                self.store.delete(f"{self.folder}/data/{name}")
            deleted += len(gone)
        return deleted

    def _has(self, batch: tuple[str, int]) -> bool:
        base = self.manifest()
        return base is not None and base["batches"].get(batch[0], -1) >= batch[1]

    def _wider(self, base: dict | None, rows: DataFrame) -> StructType:
        """The table's columns and the new ones of rows."""
        if base is None:
            return rows.schema
        old = StructType.fromJson(base["schema"])
        return StructType([*old.fields, *(f for f in rows.schema.fields if f.name not in old.names)])

    def _merge(self, rows, gone, vector, size, order, batch, group=None, unless_empty=False) -> str:
        if batch and self._has(batch):
            return self.versions()[-1]
        if vector and rows.where(F.size(vector) != size).limit(1).count():
            raise ValueError(f"vectors must have {size} components")
        key = self.layout["key"]
        last = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order), F.xxhash64(*(F.to_json(c) if t.startswith("map") else c for c, t in rows.dtypes)))
        new = self._write(rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r"))
        if unless_empty and not new and self.versions():
            return self.versions()[-1]

        def make(base):
            paths = base["paths"] if base else {}
            touched = set(new) | (self._hit(base, gone, group) if base and gone is not None else set())
            old = {b for b in touched if b in paths}
            stay = {}
            if old:
                before = self._rows(base, old)
                if gone is not None:
                    before = before.where(~gone)
                if new:
                    added = self.spark.read.schema(rows.schema).parquet(*(f"{self.folder}/data/{p[0]}" for p in new.values()))
                    before = before.join(added.select(*key), key, "left_anti")
                stay = self._write(before)
            return self._wider(base, rows), {b: stay.get(b, []) + new.get(b, []) for b in touched}

        return self._change(make, batch)

    def _hit(self, base: dict, condition: Column, group: tuple | None = None) -> set[str]:
        """The buckets with rows for which a condition holds; a group's own buckets where that is what is asked for."""
        if group and group[0] == self.layout["group"]:
            spread = self.layout["spread"]
            first = self.spark.range(1).select((F.pmod(F.xxhash64(F.lit(group[1]).cast(StructType.fromJson(base["schema"])[group[0]].dataType)), F.lit(self.layout["buckets"] // spread)) * spread).alias("b")).first().b
            return {str(b) for b in range(first, first + spread) if str(b) in base["paths"]}
        return {str(r[0]) for r in self._rows(base).where(condition).select(self.bucket()).distinct().collect()}

    def _rewrite(self, condition: Column, change) -> str:
        def make(base):
            touched = self._hit(base, condition)
            stay = self._write(change(self._rows(base, touched))) if touched else {}
            return StructType.fromJson(base["schema"]), {b: stay.get(b, []) for b in touched}

        return self._change(make)

"""Tables whose keyed writes touch only what they change (K1–K6, K9).

A keyed table is a folder.  Its rows lie in buckets by the hash of their key, each
bucket in one folder of files; a write reads the buckets of its keys, applies any
of the keyed operators to them and writes those that differ into a folder of its
own.  A manifest, one small JSON file per version, names the folder that holds each
bucket, so a version is a list of folders and nothing is ever written over: readers
keep the version they opened, a failed write leaves the table as it was, and a
write that meets a version written meanwhile is refused (:class:`Conflict`).

Rows with a null in the key are no one's update; they lie apart, are added by each
write that brings them, and are never read by one.

A write costs the rows of its buckets, not of the table.  The number of buckets is
fixed at creation from ``rows_per_bucket``; :meth:`KeyedTable.grown` lays the table
out anew when it has outgrown them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ROWS_PER_BUCKET = 1_000_000
#: The bucket of rows without a key.
LOOSE = -1


class Conflict(RuntimeError):
    """Another write made the next version first."""


class _Files:
    """Small files and folders in the store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self._path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, file: str, text: str) -> bool:
        """Whether the file was not there yet; it appears whole or not at all."""
        part = self._path(f"{file}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(file)
        done = False
        if not self.fs.exists(target):
            try:
                done = self.fs.rename(part, target)
            except Py4JJavaError:
                done = False
        if not done:
            self.fs.delete(part, False)
        return done

    def remove(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row, LOOSE where a key is null."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return F.when(whole, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).otherwise(F.lit(LOOSE))


class KeyedTable:
    """A version of a keyed table; writes return the next one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path)
        if version is None:
            known = [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
            if not known:
                raise ValueError(f"no keyed table at {path}")
            version = max(known)
        self.version = version
        self._manifest = json.loads(self.files.read(f"{self.path}/manifest/{version:012d}.json"))
        self.keys, self.buckets = self._manifest["keys"], self._manifest["buckets"]
        self.schema = T.StructType.fromJson(self._manifest["schema"])

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
               order: Sequence[str] = ()) -> "KeyedTable":
        """Write ``rows`` as version 0; rows that repeat a key are folded as updates are."""
        from .upserts import fold_keys

        spark = rows.sparkSession
        if not buckets:  # folded rows are counted by their keys alone
            loose = bucket_of(keys, 1) == LOOSE
            count = rows.filter(~loose).select(*keys).distinct().count() + rows.filter(loose).count()
            buckets = max(1, -(-count // rows_per_bucket))
        rows = fold_keys(rows, keys, order)
        folder = cls._store(rows, path.rstrip("/"), keys, buckets)
        found = cls._written(_Files(spark, path), path.rstrip("/"), folder)
        manifest = {"keys": list(keys), "buckets": buckets, "schema": rows.schema.jsonValue(),
                    "folders": {str(b): [folder] for b in found}}
        if not _Files(spark, path).create(f"{path.rstrip('/')}/manifest/{0:012d}.json", json.dumps(manifest)):
            raise Conflict(f"there is a table at {path}")
        return cls(spark, path)

    @staticmethod
    def _store(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
        """Write rows by bucket into a folder of their own: one task a bucket, unless it is large and is split."""
        folder = uuid.uuid4().hex
        (rows.withColumn("__bucket", bucket_of(keys, buckets)).hint("rebalance", "__bucket")
         .write.partitionBy("__bucket").parquet(f"{path}/data/{folder}"))
        return folder

    @staticmethod
    def _written(files: _Files, path: str, folder: str) -> list[int]:
        return [int(n.split("=")[1]) for n in files.names(f"{path}/data/{folder}") if n.startswith("__bucket=")]

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of this version, or of some of its buckets; no other files are listed."""
        wanted = self._manifest["folders"] if only is None else {str(b): self._manifest["folders"].get(str(b), []) for b in only}
        paths = [f"{self.path}/data/{folder}/__bucket={b}" for b, folders in wanted.items() for folder in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows' keys: at most one number per bucket."""
        found = rows.select(bucket_of(self.keys, self.buckets).alias("b")).distinct().collect()
        return sorted(r.b for r in found if r.b != LOOSE)

    def apply(self, operator: Callable[[DataFrame, DataFrame], DataFrame], updates: DataFrame) -> "KeyedTable":
        """The next version: ``operator(rows, updates)`` on the buckets of the updates' keys.

        The operator may change, add or drop rows with the updates' keys only, as
        the keyed writes do.  Buckets that come out as they were are not written;
        if none differs and no row without a key is added, there is no new version.
        """
        loose = bucket_of(self.keys, self.buckets) == LOOSE
        keyed, apart = updates.filter(~loose), updates.filter(loose)
        buckets = self.touched(updates)
        before = self.read(buckets)
        after = operator(before, keyed).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
        bucket = bucket_of(self.keys, self.buckets)
        # a bucket is as it was if both sides have the same rows as often: if the sums of their digests' parts, 240 bits in all, are the same
        row = F.sha2(F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in self.schema])), 256)
        part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)") * F.col("n")
        named = lambda df, sign: df.select(bucket.alias("b"), row.alias("h"), F.lit(sign).alias("n"))
        sums = [F.sum("n"), *(F.sum(part(at)) for at in (1, 16, 31, 46))]
        changed = (named(after, 1).unionByName(named(before, -1)).groupBy("b").agg(F.array(*(s.cast("decimal(38,0)") for s in sums)).alias("s"))
                   .filter(F.exists("s", lambda x: x != 0)).collect())
        differ = sorted(r.b for r in changed)
        added = operator(self.read([]), apart).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
        some = not added.isEmpty()
        if not differ and not some:
            return self
        out = after.filter(bucket.isin(differ)) if differ else after.limit(0)
        folder = self._store(out.unionByName(added) if some else out, self.path, self.keys, self.buckets)
        return self._commit(folder, differ)

    def _commit(self, folder: str, replaced: Sequence[int]) -> "KeyedTable":
        """Make the next version: the replaced buckets lie in ``folder``, what it has without a key is added."""
        written = self._written(self.files, self.path, folder)
        folders = {b: f for b, f in self._manifest["folders"].items() if int(b) not in replaced}
        for b in written:
            folders[str(b)] = [*folders.get(str(b), []), folder] if b == LOOSE else [folder]
        text = json.dumps(self._manifest | {"folders": folders})
        if not self.files.create(f"{self.path}/manifest/{self.version + 1:012d}.json", text):
            raise Conflict(f"version {self.version + 1} of {self.path} was written meanwhile")
        return KeyedTable(self.spark, self.path, self.version + 1)

    def upsert(self, updates: DataFrame, set_cols: Sequence[str], order: Sequence[str] | None = None) -> "KeyedTable":
        """K1 on the buckets of the updates' keys."""
        from .upserts import upsert

        return self.apply(lambda rows, u: upsert(rows, u, self.keys, set_cols, order), updates)

    def insert_ignore(self, rows: DataFrame, order: Sequence[str] = ()) -> "KeyedTable":
        """K6 on the buckets of the new rows' keys."""
        from .upserts import insert_ignore

        return self.apply(lambda known, new: insert_ignore(known, new, self.keys, order), rows)

    def delete(self, gone: DataFrame) -> "KeyedTable":
        """K9 by key: the rows whose key is in ``gone`` leave."""
        return self.apply(lambda rows, u: rows.join(u.select(*self.keys).distinct(), self.keys, "left_anti"), gone.select(*self.keys).filter(
            bucket_of(self.keys, self.buckets) != LOOSE))

    def grown(self, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> "KeyedTable":
        """The same rows laid out anew under another path."""
        return KeyedTable.create(self.read(), path, self.keys, rows_per_bucket=rows_per_bucket)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` versions uses, and older manifests; writes must not be under way."""
        names = [n for n in self.files.names(f"{self.path}/manifest") if n.endswith(".json")]
        used = {f for n in names[-keep:] for fs in json.loads(self.files.read(f"{self.path}/manifest/{n}"))["folders"].values() for f in fs}
        gone = [f for f in self.files.names(f"{self.path}/data") if f not in used]
        for n in names[:-keep]:
            self.files.remove(f"{self.path}/manifest/{n}")
        for f in gone:
            self.files.remove(f"{self.path}/data/{f}")
        return gone

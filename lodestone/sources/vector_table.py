"""A vector collection as a catalogue-free Parquet table in buckets by key; a manifest says which version of each is current."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval

#: Buckets of a new collection: a write replaces those that its keys fall into.
BUCKETS = 16


class Collection(Protocol):
    """What any vector store offers."""

    def exists(self) -> bool: ...
    def create(self, df: DataFrame, recreate: bool = False) -> None: ...
    def upsert(self, df: DataFrame) -> None: ...
    def delete(self, keys: DataFrame) -> None: ...
    def get(self, keys: DataFrame) -> DataFrame: ...
    def scan(self) -> DataFrame: ...
    def search(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None, filters: dict | None = None) -> DataFrame: ...
    def count(self) -> int: ...
    def info(self) -> dict: ...
    def drop(self) -> None: ...


class VectorTable:
    """Rows (chunk_id, embedding, content, ... payload columns).

    A write makes new versions of the buckets it touches and then a new manifest; nothing old is changed, so readers and
    failed jobs see whole tables only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", metric: str = "cosine", buckets: int = BUCKETS):
        if metric not in ("cosine", "dot", "euclidean"):
            raise ValueError("metric is cosine, dot or euclidean")
        self.spark, self.path, self.key, self.metric, self.buckets = spark, path.rstrip("/"), key, metric, buckets

    def _at(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._at("manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("m") and n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def _manifest(self) -> dict:
        """schema, buckets, parts (bucket to version) of the current version."""
        rows = self.spark.read.text(f"{self.path}/manifests/m{self.versions()[-1]}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def _commit(self, number: int, manifest: dict) -> None:
        p, fs = self._at("manifests", f"_m{number}.tmp")
        out = fs.create(p, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not fs.rename(p, self._at("manifests", f"m{number}.json")[0]):
            raise RuntimeError("another writer made this version")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, buckets: int, kept: dict[str, int], touched: list[int]) -> None:
        number = (self.versions() or [-1])[-1] + 1
        df.withColumn("__bucket", self._bucket(buckets)).write.partitionBy("__bucket").parquet(f"{self.path}/data/v{number}")
        _, fs = self._at()
        parts = {b: v for b, v in kept.items() if int(b) not in touched}
        parts |= {str(b): number for b in touched if fs.exists(self._at("data", f"v{number}", f"__bucket={b}")[0])}
        self._commit(number, {"schema": df.schema.json(), "buckets": buckets, "parts": parts})

    def create(self, df: DataFrame, recreate: bool = False) -> None:
        if self.exists() and not recreate:
            return
        self._write(df, self.buckets, {}, list(range(self.buckets)))

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/data/v{v}/__bucket={b}" for b, v in sorted(manifest["parts"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scan(self) -> DataFrame:
        return self._read(self._manifest())

    def _touched(self, keys: DataFrame, buckets: int) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(buckets).alias("b")).distinct().collect())  # no more than there are buckets

    def upsert(self, df: DataFrame) -> None:
        """Insert or replace by key; rows without an embedding are an error. Of repeated new keys one wins (most columns equal: any)."""
        if not df.where("embedding is null").isEmpty():
            raise ValueError("rows without embedding")
        w = Window.partitionBy(self.key).orderBy(F.xxhash64(*df.columns))
        new = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        if not self.exists():
            self._write(new, self.buckets, {}, list(range(self.buckets)))
            return
        manifest = self._manifest()
        touched = self._touched(new, manifest["buckets"])
        old = self._read(manifest, touched).join(new.select(self.key), self.key, "left_anti")
        whole = old.unionByName(new, allowMissingColumns=True)
        if whole.schema != old.schema:  # new payload columns: every bucket gets them
            touched, whole = list(range(manifest["buckets"])), self._read(manifest).join(new.select(self.key), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        self._write(whole, manifest["buckets"], manifest["parts"], touched)

    def delete(self, keys: DataFrame) -> None:
        manifest = self._manifest()
        touched = self._touched(keys, manifest["buckets"])
        self._write(self._read(manifest, touched).join(keys.select(self.key), self.key, "left_anti"), manifest["buckets"], manifest["parts"], touched)

    def get(self, keys: DataFrame) -> DataFrame:
        manifest = self._manifest()
        return self._read(manifest, self._touched(keys, manifest["buckets"])).join(keys.select(self.key), self.key, "left_semi")

    def lookup(self, column: str, value, k: int = 10) -> DataFrame:
        """The first k rows by key with that payload value."""
        return self.scan().where(F.col(column) == F.lit(value)).orderBy(self.key).limit(k)

    def count(self) -> int:
        return self.scan().count()

    def info(self) -> dict:
        row = self.scan().agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
        return {"rows": row["n"], "dimension": row["d"] or 0, "metric": self.metric, "versions": self.versions()}

    def search(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None, filters: dict | None = None) -> DataFrame:
        """Batch search; filters (equality, or membership for lists) apply before ranking and reach the scan."""
        rows = self.scan()
        for name, value in (filters or {}).items():
            rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
        return retrieval.dense(rows, queries, top_k, self.metric, threshold, self.key)

    def copy_to(self, path: str) -> VectorTable:
        other = VectorTable(self.spark, path, self.key, self.metric, self.buckets)
        other.create(self.scan(), recreate=True)
        return other

    def drop(self) -> None:
        p, fs = self._at()
        fs.delete(p, True)


def collections(spark: SparkSession, folder: str) -> list[str]:
    """Names of the collections below a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if VectorTable(spark, f"{folder.rstrip('/')}/{n}").exists())

"""A table with versions: keyed upserts and tombstones, applied in batches that may be replayed or come out of order.

Rows live in Parquet folders by hash bucket of their key. A version is one small manifest that names the folder of each bucket; it is created only where no file of
its number exists, so of two writers one wins and the other applies its batch to what the first has made. Readers take the newest whole manifest, and what
it names is never changed, so they see whole versions. A batch rewrites the buckets that its keys fall into.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from foldline.operators.runs import row_digest

_EXTRA = {"_seq": LongType(), "_deleted": BooleanType(), "_bucket": IntegerType()}


class VersionedTable:
    """``path`` in any store that Spark writes; ``key`` names the column that rows are upserted by. ``buckets`` counts for a new table only."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:020d}.json"

    def versions(self) -> list[int]:
        """Numbers of all manifests, whole or not; there are as many as batches were applied and not yet forgotten by ``vacuum``."""
        fs, at = self._fs(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of ``version``, or the newest whole one; None for a table without any."""
        for v in [version] if version is not None else reversed(self.versions()):
            fs, at = self._fs(self._manifest(v))
            stream = fs.open(at)
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:  # its writer died, or has not ended
                if version is not None:
                    raise
        return None

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest became its version; False where another writer was first."""
        fs, at = self._fs(self._manifest(manifest["version"]))
        try:
            out = fs.create(at, False)
        except Exception as e:  # py4j wraps what the store throws
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        return True

    def _rows(self, manifest: dict | None, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a version, tombstones too, of ``buckets`` only if given."""
        whole = StructType(list(schema.fields))
        for name, kind in _EXTRA.items():
            whole = whole.add(name, kind)
        named = {} if manifest is None else manifest["buckets"]
        paths = [p for b, p in named.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def apply(self, changes: DataFrame, writer: str, batch: int, *, seq: str = "seq", deleted: str = "deleted") -> int:
        """Apply a batch of rows with the columns ``seq`` (which of two states of a key is newer) and ``deleted``; returns the version that holds it.

        Of all states of a key that were ever applied the one with the greatest ``seq`` counts, so batches may come in any order; of equal ones, a tombstone, then the row that is in the table, then the greatest. A writer's batches have
        rising numbers: one that is not above its last is a replay and changes nothing. Tombstones stay, so that an older state cannot come back. Rows with a null key or ``seq`` are
        an error. Columns must be those of the table.
        """
        data = [c for c in changes.columns if c not in (seq, deleted)]
        while True:
            now = self.manifest()
            if now is not None and now["batches"].get(writer, -1) >= batch:
                return now["version"]
            schema = StructType.fromJson(now["schema"]) if now else changes.select(*data).schema
            if sorted(schema.names) != sorted(data):
                raise ValueError(f"the table has columns {schema.names}, the batch {data}")
            n = now["n_buckets"] if now else self.buckets
            whole = F.when(F.col(self.key).isNull() | F.col(seq).isNull(), F.raise_error(F.lit("rows need a key and a number"))).otherwise(F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int"))
            new = changes.select(*schema.names, F.col(seq).cast("bigint").alias("_seq"), F.coalesce(F.col(deleted), F.lit(False)).alias("_deleted"), whole.alias("_bucket"), F.lit(False).alias("_held"))
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # no more than there are buckets
            old = self._rows(now, schema, touched).withColumn("_held", F.lit(True))
            columns = [*schema.names, *_EXTRA]
            both = old.select(*columns, "_held").unionByName(new.select(*columns, "_held"))
            newest = F.struct("_seq", "_deleted", "_held", row_digest(both.select(*schema.names)))
            last = both.groupBy(self.key, "_bucket").agg(F.max_by(F.struct(*columns), newest).alias("row"))
            at = f"{self.path}/data/{uuid.uuid4().hex}"
            buckets = dict(now["buckets"]) if now else {}
            if touched:
                last.select("row.*").withColumn("_part", F.col("_bucket")).repartition(len(touched), "_part").write.partitionBy("_part").parquet(at)
                buckets |= {str(b): f"{at}/_part={b}" for b in touched}
            made = {
                "version": (now["version"] if now else 0) + 1, "batches": (now["batches"] if now else {}) | {writer: batch}, "n_buckets": n, "schema": json.loads(schema.json()), "buckets": buckets,
            }
            while made["version"] in self.versions() and (held := self.manifest()) is not None and held["version"] < made["version"]:
                made["version"] += 1  # a broken manifest keeps its number
            if self._publish(made):
                return made["version"]

    def read(self, version: int | None = None, *, tombstones: bool = False) -> DataFrame:
        """The rows of a version, by default the newest; with ``tombstones``, deleted ones too and the columns _seq and _deleted."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"no table at {self.path}")
        schema = StructType.fromJson(found["schema"])
        rows = self._rows(found, schema)
        return rows.select(*schema.names, "_seq", "_deleted") if tombstones else rows.where("NOT _deleted").select(*schema.names)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data and manifests that only versions before the newest ``keep`` name; returns how many folders went. No batch may be under way."""
        whole = [m for v in self.versions() if (m := self._whole(v)) is not None]
        fs, at = self._fs(f"{self.path}/data")
        if not whole or not fs.exists(at):
            return 0
        kept = {p.rsplit("/", 2)[1] for m in whole[-keep:] for p in m["buckets"].values()}
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in kept]
        for m in whole[:-keep]:
            fs.delete(self._fs(self._manifest(m["version"]))[1], False)
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def _whole(self, version: int) -> dict | None:
        try:
            return self.manifest(version)
        except ValueError:
            return None

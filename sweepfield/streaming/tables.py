"""Tables that micro-batches are merged into."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpointed
from ..storage import Files


class BucketedTable:
    """A Parquet table in hash buckets of its keys, of which a micro-batch rewrites only those it touches.

    A batch writes its buckets below its own number and then publishes a
    manifest that names every bucket's newest number; the manifest's rename is the
    commit. A batch that is run again reads the manifest before its own and
    writes the same again. The last ``keep`` manifests and what they name stay.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path, list(keys), buckets, keep
        self.files = Files(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _numbers(self) -> list[int]:
        return [int(n) for n in self.files.names("manifests") if n.isdigit()]

    def manifest(self, number: int) -> dict:
        return json.loads(self.files.read(f"manifests/{number:012d}"))

    def _rows(self, places: dict[str, int]) -> DataFrame | None:
        folders = [f"{self.path}/data/{number:012d}/bucket={bucket}" for bucket, number in sorted(places.items())]
        return self.spark.read.parquet(*folders) if folders else None

    def merge(self, batch: DataFrame, number: int, combine: Callable[[DataFrame], DataFrame]) -> dict:
        """Put the rows of ``batch`` into the table; ``combine`` reduces old and new rows of a key to the rows that stay.

        Returns the published manifest: buckets, and the rows and bytes that were written.
        """
        numbers = [n for n in self._numbers() if n < number]
        places = self.manifest(numbers[-1])["buckets"] if numbers else {}
        new = checkpointed(combine(batch).withColumn("bucket", self._bucket()))
        # At most as many values as there are buckets.
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        old = self._rows({str(b): places[str(b)] for b in touched if str(b) in places})
        new = new.drop("bucket")
        whole = new if old is None else combine(old.select(*new.columns).unionByName(new))
        folder = f"data/{number:012d}"
        (whole.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}"))
        written = {n.split("=")[1]: number for n in self.files.names(folder) if n.startswith("bucket=")}
        kept = {b: n for b, n in places.items() if int(b) not in touched}
        made = {"buckets": kept | written, "touched": len(touched), "bytes": self.files.bytes(folder)}
        self.files.publish(f"manifests/{number:012d}", json.dumps(made))
        self._forget()
        return made

    def _forget(self) -> None:
        numbers = self._numbers()
        for n in numbers[:-self.keep]:
            self.files.delete(f"manifests/{n:012d}")
        named = {(b, n) for m in numbers[-self.keep:] for b, n in self.manifest(m)["buckets"].items()}
        for folder in self.files.names("data"):
            mine = [n for n in self.files.names(f"data/{folder}") if n.startswith("bucket=")]
            gone = [n for n in mine if (n.split("=")[1], int(folder)) not in named]
            if int(folder) > numbers[-1]:
                continue
            for n in gone:
                self.files.delete(f"data/{folder}/{n}")
            if len(gone) == len(mine):
                self.files.delete(f"data/{folder}")

    def latest(self) -> DataFrame | None:
        numbers = self._numbers()
        return self._rows(self.manifest(numbers[-1])["buckets"]) if numbers else None

    def history(self) -> list[dict]:
        """The kept manifests with their numbers, oldest first."""
        return [{"number": n} | self.manifest(n) for n in self._numbers()]

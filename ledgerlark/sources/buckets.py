"""Keyed rows that batches update: hash buckets of which a batch reads and rewrites the touched ones only.

    <path>/data/gen=7/__bucket=12/...   what batch 7 made of bucket 12
    <path>/manifest/gen=7/...           which generation holds each bucket after batch 7, and some facts

A manifest is written last, so readers see a batch whole or not at all.  A batch starts from the newest manifest
below its own number: run again, it makes the same generation again, whatever of it was left behind.
What no kept manifest refers to is removed after publishing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"
_MANIFEST = "buckets map<int,bigint>, facts map<string,string>"
#: Published generations that stay readable: the newest one and that before it, which a replay starts from.
KEPT = 2


class Buckets:
    """The table below *path*, dealt to a fixed number of *buckets* by its *keys*."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    # --- what is published ---

    def _children(self, folder: str, prefix: str) -> list[int]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def _remove(self, folder: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def published(self, below: int | None = None) -> tuple[int, dict[int, int], dict[str, str]] | None:
        """(generation, generation of each bucket, facts) of the newest manifest, or of the newest one *below* a batch."""
        for gen in reversed(self._children("manifest", "gen=")):
            if below is None or gen < below:
                row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/gen={gen}").first()
                if row is not None:  # a folder without a row was never published
                    return gen, dict(row["buckets"]), dict(row["facts"])
        return None

    def paths(self, held: dict[int, int]) -> list[str]:
        return [f"{self.path}/data/gen={gen}/{BUCKET}={b}" for b, gen in sorted(held.items())]

    def _rows(self, held: dict[int, int]) -> DataFrame | None:
        return self.spark.read.parquet(*self.paths(held)) if held else None

    def read(self) -> DataFrame | None:
        """All rows after the newest batch; None before the first one."""
        found = self.published()
        return self._rows(found[1]) if found else None

    # --- a batch ---

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets that the keys of *rows* fall into."""
        return {r[0] for r in self._bucketed(rows.select(*self.keys)).select(BUCKET).distinct().collect()}  # as many as buckets at most

    def rows_around(self, rows: DataFrame, below: int) -> DataFrame | None:
        """What batches below the given one hold in the buckets that *rows* touches."""
        found = self.published(below)
        return self._rows({b: g for b, g in found[1].items() if b in self.touched(rows)}) if found else None

    def upsert(self, rows: DataFrame, generation: int, merge: Callable[[DataFrame], DataFrame], *, facts: dict[str, str] | None = None) -> None:
        """Bring *rows* in as batch *generation* and publish it with its *facts*.

        *merge* gets the earlier rows of the touched buckets (``__new`` false) and *rows* (``__new`` true) and returns what is to be kept of both.
        """
        before = self.published(generation)
        held, known = ({}, {}) if before is None else before[1:]
        touched = self.touched(rows)
        old = self._rows({b: g for b, g in held.items() if b in touched})
        both = rows.withColumn("__new", F.lit(True))
        if old is not None:
            both = both.unionByName(old.withColumn("__new", F.lit(False)))
        folder = f"{self.path}/data/gen={generation}"
        self._bucketed(merge(both).drop("__new")).repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(folder)
        written = set(self._children(f"data/gen={generation}", f"{BUCKET}="))
        now = {b: g for b, g in held.items() if b not in touched} | dict.fromkeys(written, generation)
        row = self.spark.createDataFrame([(now, {**known, **(facts or {})})], _MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/gen={generation}")
        self._tidy(generation)

    def _tidy(self, generation: int) -> None:
        """Remove manifests older than those kept, and generations that none of these refers to."""
        gens = [g for g in self._children("manifest", "gen=") if g <= generation]
        used: set[int] = set()
        for gen in gens[-KEPT:]:
            row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/gen={gen}").first()
            used |= set(row["buckets"].values()) if row is not None else set()
        for gen in gens[:-KEPT]:
            self._remove(f"manifest/gen={gen}")
        for gen in self._children("data", "gen="):
            if gen <= generation and gen not in used:
                self._remove(f"data/gen={gen}")


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge: a batch's row replaces the earlier row of its key."""
    def merge(both: DataFrame) -> DataFrame:
        rest = [c for c in both.columns if c not in (*keys, "__new")]
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__new").alias("__v")).select(*keys, "__v.*")

    return merge

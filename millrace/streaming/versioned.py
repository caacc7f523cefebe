"""A table of numbered versions in the shared folder, as an idempotent sink of streams.

A version is written whole to a folder of its own and counts once its marker stands beside it. What was written without a marker, by a batch
that failed between the two, is overwritten when the batch is repeated; a batch whose marker stands is not done again. Readers take
the version that a pointer names, or the last one with a marker; rolling back moves the pointer, and versions after it go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.streaming.stateful import transactional


class Versions:
    """Versions below path, of rows of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 3) -> None:
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the versions that count, ascending."""
        place, fs = self._place("")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("_commit-"))

    def last(self) -> int | None:
        found = self.committed()
        return found[-1] if found else None

    def read(self, version: int | None = None) -> DataFrame:
        """A version, by default the last; empty if there is none."""
        version = self.last() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={version}")

    def write(self, version: int, rows: DataFrame) -> None:
        """Writes a version without making it count."""
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def commit(self, version: int) -> None:
        place, fs = self._place(f"_commit-{version}")
        fs.create(place, True).close()
        for old in self.committed()[: -self.keep]:
            self._drop(old)

    def roll_back(self, version: int) -> None:
        """Makes version the last one; the marker of the highest goes first, so that a failure on the way leaves a version that counts."""
        for newer in reversed([v for v in self.committed() if v > version]):
            self._drop(newer)

    def _drop(self, version: int) -> None:
        for name in (f"_commit-{version}", f"version={version}"):
            place, fs = self._place(name)
            fs.delete(place, True)

    def advance(self, version: int, step: Callable[[DataFrame], DataFrame]) -> bool:
        """Makes version from the one before it, unless it counts already; whether it was made now."""
        done = self.committed()
        if version in done:
            return False
        before = [v for v in done if v < version]
        self.write(version, step(self.read(before[-1]) if before else self.spark.createDataFrame([], self.schema)))
        self.commit(version)
        return True


def transactions(stream: DataFrame, path: str, checkpoint: str, ns: str, key: str, value: str, seq: str) -> Versions:
    """The (ns, key, good, working) that a stream of sets, successes and fails leaves, a version a batch; see stateful.transactional.

    Batches follow each other in order of seq, as an ordered log does. The version before goes ahead of a batch as a log of its own: what is good as sets with a
    success after them, what is only in the working copy as sets after that."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"`{ns}` {types[ns]}, `{key}` {types[key]}, good {types[value]}, working {types[value]}"
    versions = Versions(stream.sparkSession, path, schema)

    def batch(df: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        def step(state: DataFrame) -> DataFrame:
            row = lambda rows, k, v, at, op: rows.select(F.col(ns), k.cast(types[key]).alias(key), v.cast(types[value]).alias(value), F.lit(at).cast(types[seq]).alias(seq), F.lit(op).alias("op"))
            none = F.lit(None)
            good, changed = state.filter("good IS NOT NULL"), state.filter("NOT working <=> good")
            ahead = row(good, F.col(key), F.col("good"), -3, "set").unionAll(row(good.select(ns).distinct(), none, none, -2, "success")).unionAll(row(changed, F.col(key), F.col("working"), -1, "set"))
            return transactional(ahead.unionByName(df.select(ns, key, value, seq, "op")), ns, key, value, seq)

        Versions(df.sparkSession, path, schema).advance(number, step)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return versions

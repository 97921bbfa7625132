"""A log-structured state table for ``foreachBatch``.

Each batch appends only the rows it changed, in a folder named by its id
that a replay overwrites. A read before batch ``b`` merges the newest base
with the changes of the batches between that base and ``b``, so a replayed
batch never sees its own writes. Now and then a compaction folds the changes
into a new base; older bases and changes are retired once a newer base than
the one they serve has been committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "batch_version"


def newest_by(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: of the rows of one key the one of the newest batch holds."""
    def merge(rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c != VERSION]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), VERSION).alias("_row"))
        return newest.select(*[F.col(f"_row.{c}").alias(c) for c in cols])
    return merge


class BatchLog:
    """State of one stream under ``root``; ``merge`` folds rows with a ``batch_version`` column.

    ``merge`` must be associative: folding a base with later changes gives
    what folding all changes gives. ``initial`` is a Parquet folder with the
    rows before the first batch. ``retire``, if given, drops rows that a
    compaction need not keep.
    """

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], initial: str | None = None,
                 compact_every: int = 16, retire: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.merge, self.initial = spark, root.rstrip("/"), merge, initial
        self.compact_every, self.retire = compact_every, retire

    # -------------------------------------------------------------- folders
    def _path(self, kind: str, n: int) -> str:
        return f"{self.root}/{kind}/{kind}_id={n}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self, kind: str) -> list[int]:
        """Ids of the committed ``base`` or ``change`` folders, ascending."""
        fs, p = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith(f"{kind}_id=") and fs.exists(self._fs(f"{self.root}/{kind}/{name}/_SUCCESS")[1]):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    # ---------------------------------------------------------------- reads
    def before(self, batch_id: int, only: DataFrame | None = None) -> DataFrame | None:
        """The state before ``batch_id``; None if there is none yet.

        ``only`` has key columns of the rows wanted: others are dropped by a
        semi-join before anything is shuffled for the merge.
        """
        return self._merged(batch_id, batch_id, only)

    def _pending(self, base_before: int, changes_before: int) -> tuple[int | None, list[int]]:
        base = max((b for b in self.committed("base") if b < base_before), default=None)
        return base, [c for c in self.committed("change") if (base is None or c > base) and c < changes_before]

    def _merged(self, base_before: int, changes_before: int, only: DataFrame | None = None) -> DataFrame | None:
        base, changes = self._pending(base_before, changes_before)
        parts = []
        if base is not None:
            parts.append(self.spark.read.parquet(self._path("base", base)).withColumn(VERSION, F.lit(-1).cast("long")))
        elif self.initial:
            parts.append(self.spark.read.parquet(self.initial).withColumn(VERSION, F.lit(-1).cast("long")))
        if changes:
            # Folder names become a column; the folders read are named one by one.
            read = self.spark.read.option("basePath", f"{self.root}/change").parquet(*[self._path("change", c) for c in changes])
            parts.append(read.withColumn(VERSION, F.col("change_id").cast("long")).drop("change_id"))
        if not parts:
            return None
        if only is not None:
            parts = [p.join(only, only.columns, "left_semi") for p in parts]
        if len(parts) == 1 and not changes:
            return parts[0].drop(VERSION)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return self.merge(rows)

    # --------------------------------------------------------------- writes
    def append(self, batch_id: int, rows: DataFrame) -> None:
        """Record what ``batch_id`` changed, then compact if enough changes have gathered."""
        rows.write.mode("overwrite").parquet(self._path("change", batch_id))
        if len(self._pending(batch_id, batch_id + 1)[1]) >= self.compact_every:
            self.compact(batch_id)

    def compact(self, through: int) -> None:
        """Write a base of all batches up to ``through`` and retire what it replaces.

        The base before it and the changes since then stay: a replay of
        ``through`` still needs them.
        """
        state = self._merged(through, through + 1)
        if state is None:
            return
        if self.retire:
            state = self.retire(state)
        state.write.mode("overwrite").parquet(self._path("base", through))
        bases = [b for b in self.committed("base") if b < through]
        if bases:
            keep = bases[-1]
            old = [("base", b) for b in bases[:-1]] + [("change", c) for c in self.committed("change") if c <= keep]
            for kind, n in old:
                fs, p = self._fs(self._path(kind, n))
                fs.delete(p, True)

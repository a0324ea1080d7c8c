"""Artifacts of a run: unified rows, conflict groups and data quality, exported and read back.

An export is a folder of tables under ``run=<name>``, in JSON lines; it counts once its ``quality`` is there, which is
written last, so readers never see half of one.  The reader serves the latest run, keeps what it has opened, and says
of what is missing how it is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import KEY, place

#: How each artifact is made.
MADE_BY = {"unified": "export", "conflicts": "export", "quality": "export", "quarantine": "export", "patterns": "discovery", "anomalies": "anomaly scan", "predictions": "prediction", "models": "training", "experiments": "experiment"}


def unified_rows(placed: DataFrame) -> DataFrame:
    """Rows that stand for their measurement, with the three times apart and how many observations they stand for."""
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS") for c in ("event_time", "source_time", "received_time") if c in placed.columns}
    return placed.filter("placement = 'unified'").withColumns(times).drop("placement", "group_placement", "representative_id")


def conflict_groups(placed: DataFrame) -> DataFrame:
    """(key, observations, values, spread) of each group whose observations disagree; groups hold what one measurement's sources say."""
    keys = [c for c in KEY if c in placed.columns]
    member = F.struct("observation_id", "source_id", "value")
    g = placed.filter("placement = 'conflicted'").groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("observations"), (F.max("value") - F.min("value")).alias("spread"))
    return g.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS"))


def quality_row(placed: DataFrame, rejected: DataFrame, health: DataFrame, reason: str = "quarantine_reason") -> DataFrame:
    """One row: rows in, valid, quarantined by reason, missing values, placements, sources by status, and whether every row is accounted for.

    rejected: rows with their reason; health: (source_id, status).  Reasons, placements and sources are few.
    """
    counted = lambda t, c: t.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("m"))
    g = placed.agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col("value").isNull()).alias("missing_values"))
    g = g.crossJoin(counted(rejected, reason).withColumnRenamed("m", "quarantine_by_reason")).crossJoin(counted(placed, "placement").withColumnRenamed("m", "placements"))  # one row each
    g = g.crossJoin(health.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_id", "status")))).alias("source_health")))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, b: a + b)
    g = g.withColumn("quarantined", total("quarantine_by_reason")).withColumn("rows_in", F.col("valid") + F.col("quarantined"))
    return g.withColumn("accounts_for_every_row", total("placements") == F.col("valid"))


def export(obs: DataFrame, rejected: DataFrame, health: DataFrame, path: str, run: str) -> None:
    """Write one run's unified rows, conflict groups, quarantine and quality; a run that is written again replaces itself."""
    placed = place(obs)
    root = f"{path.rstrip('/')}/run={run}"
    unified_rows(placed).write.mode("overwrite").json(f"{root}/unified")
    conflict_groups(placed).write.mode("overwrite").json(f"{root}/conflicts")
    rejected.write.mode("overwrite").json(f"{root}/quarantine")
    quality_row(placed, rejected, health).write.mode("overwrite").json(f"{root}/quality")


class ArtifactReader:
    """Tables of the latest finished run under a folder; None for what is not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._open: dict[str, DataFrame | None] = {}

    def clear(self) -> None:
        """Forget what was opened, so that a newer run is seen."""
        self._open.clear()

    def _there(self, where: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def runs(self) -> list[str]:
        """Finished runs, newest name first."""
        if not self._there(self.path):
            return []
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        return sorted((n[4:] for n in names if n.startswith("run=") and self._there(f"{self.path}/{n}/quality/_SUCCESS")), reverse=True)

    def read(self, name: str) -> DataFrame | None:
        if name not in self._open:
            found = self.runs()
            where = f"{self.path}/run={found[0]}/{name}" if found else None
            self._open[name] = self.spark.read.json(where) if where and self._there(where) else None
        return self._open[name]

    def availability(self) -> DataFrame:
        """(artifact, available, rows, note) of every artifact: a note says how a missing one is made."""
        rows = []
        for name in sorted(MADE_BY):
            table = self.read(name)
            n = table.count() if table is not None else 0
            rows.append((name, n > 0, n, None if n else f"made by {MADE_BY[name]}"))
        return self.spark.createDataFrame(rows, "artifact string, available boolean, rows long, note string")

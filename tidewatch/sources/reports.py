"""Run-stamped reports and the model registry, as tables in a shared folder."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitoring import ModelRegistry


class ReportStore:
    """Tables by run under one folder; a run that is written again replaces itself only."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, run: str) -> None:
        rows.write.mode("overwrite").json(f"{self.path}/run={run}")

    def read(self, run: str | None = None) -> DataFrame:
        """Rows of one run, or of all; no rows if there is no run."""
        try:
            rows = self.spark.read.schema(f"{self.schema}, run string").json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], f"{self.schema}, run string")
        return rows if run is None else rows.filter(F.col("run") == run)

    def runs(self) -> list[str]:
        """Names of the runs, newest first: one row each."""
        return [r["run"] for r in self.read().select("run").distinct().orderBy(F.desc("run")).collect()]

    def latest(self) -> DataFrame:
        found = self.runs()
        return self.read(found[0]) if found else self.read()


class Conflict(RuntimeError):
    """Another writer was faster, and what was asked for no longer holds."""


class StoredRegistry(ModelRegistry):
    """A registry whose every change is a file of a log, written by any number of writers.

    Change number n is the file that is first to have that name: a writer reads the log, checks its change against
    it, and puts file n + 1 in place as a whole; if there is one by then, it reads on and tries again.  So there is
    one champion at most whoever writes.  Models are a few hundred rows: all come to the driver.
    """

    #: Tries of one change.
    TRIES = 100

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self.spark, self.path, self.seq = spark, path.rstrip("/"), 0
        self.refresh()

    # files

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _put(self, seq: int, rows: list[dict]) -> bool:
        """Whether these rows became change number seq."""
        text = json.dumps(rows, sort_keys=True)
        name, draft = f"{seq:09d}.json", f"_draft-{uuid.uuid4().hex}"
        local = self.path[5:] if self.path.startswith("file:") else None if "://" in self.path else self.path
        if local is not None:
            os.makedirs(local, exist_ok=True)
            with open(f"{local}/{draft}", "w") as f:
                f.write(text)
            try:
                os.link(f"{local}/{draft}", f"{local}/{name}")  # fails if the name is taken
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{local}/{draft}")
            return True
        files = self._files()
        out = files.create(self._place(draft), True)
        out.write(text.encode())
        out.close()
        if files.exists(self._place(name)) or not files.rename(self._place(draft), self._place(name)):
            files.delete(self._place(draft), False)
            return False
        return True

    def changes(self) -> DataFrame:
        """(seq, version, status, supersedes, facts): the whole log."""
        schema = "version string, status string, supersedes string, facts string"
        root = self._place("")
        if not self._files().exists(root):
            return self.spark.createDataFrame([], f"seq long, {schema}")
        rows = self.spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(self.path)
        return rows.select(F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)", 1).cast("long").alias("seq"), "version", "status", "supersedes", "facts")

    def refresh(self) -> None:
        """The registry as the log has it now."""
        self.rows, self.seq = {}, 0
        for r in sorted(self.changes().collect(), key=lambda r: (r["seq"], r["status"] == "champion")):
            self.seq = max(self.seq, r["seq"])
            self.rows[r["version"]] = {"version": r["version"], "status": r["status"], "supersedes": r["supersedes"], **json.loads(r["facts"] or "{}")}

    def _commit(self, change: Callable[[], list[str]]) -> None:
        for _ in range(self.TRIES):
            self.refresh()
            rows = []
            for v in change():
                own = self.rows[v]
                rows.append({"version": v, "status": own["status"], "supersedes": own["supersedes"], "facts": json.dumps({k: x for k, x in own.items() if k not in ("version", "status", "supersedes")}, sort_keys=True)})
            if self._put(self.seq + 1, rows):
                self.seq += 1
                return
        raise Conflict(f"no change after {self.TRIES} tries")

    # changes

    def register(self, version: str, **facts: object) -> None:
        def change() -> list[str]:
            ModelRegistry.register(self, version, **facts)
            return [version]

        self._commit(change)

    def promote(self, version: str, expected: str | None = None) -> None:
        """Make version the champion; with expected, only if that is the champion still."""

        def change() -> list[str]:
            before = self.champion()
            if expected is not None and before != expected:
                raise Conflict(f"{before} is the champion, not {expected}")
            ModelRegistry.promote(self, version)
            return [*([before] if before and before != version else []), version]

        self._commit(change)

    def reject(self, version: str) -> None:
        def change() -> list[str]:
            ModelRegistry.reject(self, version)
            return [version]

        self._commit(change)

    # views

    def table(self) -> DataFrame:
        """(version, status, supersedes) of every model: its last change."""
        last = self.changes().groupBy("version").agg(F.max_by(F.struct("status", "supersedes"), F.struct("seq", F.col("status") == "champion")).alias("x"))
        return last.select("version", "x.*")

    def lineage_table(self, version: str) -> DataFrame:
        """(version, status, supersedes, depth) from version back to the first model, by recursion over the log's last states."""
        return self.spark.sql(
            """WITH RECURSIVE line AS (SELECT version, status, supersedes, 0 AS depth FROM {models} WHERE version = {version}
            UNION ALL SELECT m.version, m.status, m.supersedes, line.depth + 1 FROM line JOIN {models} m ON m.version = line.supersedes)
            SELECT * FROM line ORDER BY depth""",
            models=self.table(), version=version,
        )

    def rendered(self, version: str) -> str:
        """The lineage of a version as text, newest first."""
        facts = lambda v: ", ".join(f"{k} {x}" for k, x in sorted(self.rows[v].items()) if k not in ("version", "status", "supersedes"))
        lines = [f"{r['version']} ({r['status']})" + (f": {facts(r['version'])}" if facts(r["version"]) else "") for r in self.lineage_table(version).collect()]
        return "\n".join(f"{'  ' * k}{'supersedes ' if k else ''}{line}" for k, line in enumerate(lines))


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small table as text for people; more rows than most are refused rather than cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(rows.columns), line(["-"] * len(rows.columns)), *map(line, found), ""])

"""The medallion lake: bronze JSON (gzip), silver and gold Parquet, by project and date."""

import uuid
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateline import fixed_values as fv
from lateline.functions.numbers import iso_text, moment
from lateline.functions.text import is_project_key
from lateline.operators.flatten import nested_to_json
from lateline.operators.incremental import latest
from lateline.schemas import ALERT, STATE
from lateline.sources import schema_union
from lateline.sources.staging import brief_shuffles

_PARTITIONS = ["project", "date"]
_RUN = "run"


def _tier(tier, run_id):
    """Runs with an id lie beside what was appended without one."""
    return tier if run_id is None else f"{tier}_runs"


def new_run_id():
    """An id that sorts behind those given out before it."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ-") + uuid.uuid4().hex[:8]


def _filesystem(spark, path):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def path_exists(spark, path):
    filesystem, location = _filesystem(spark, path)
    return filesystem.exists(location)


class Lake:
    """Tables under one root. Each write appends; all projects go in one job."""

    def __init__(self, spark, root):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, tier, name):
        return f"{self.root}/{tier}/{name}"

    def _files(self, path):
        filesystem, _ = _filesystem(self.spark, path)
        return filesystem, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _write(self, df, path, file_format, run_date, key, run_id=None):
        day = F.date_format(moment(run_date), "yyyy-MM-dd")
        placed = df.withColumns({"project": F.col(key), "date": day})
        # even file sizes: small projects share a task, a dominant one is split over many
        placed = placed.hint("rebalance", "project")
        if file_format == "parquet":
            schema_union.record(*self._files(path), path, df.schema)
        writer = placed.write.mode("append")
        if run_id is not None:
            # a folder per run, so that a repeated run replaces its own rows and no others
            path = f"{path}/{_RUN}={run_id}"
            writer = placed.write.mode("overwrite")
        with brief_shuffles(df.sparkSession):
            writer.partitionBy(*_PARTITIONS).format(file_format).option(
                "compression", "snappy" if file_format == "parquet" else "gzip"
            ).save(path)
        return path

    def write_bronze(self, df, source, run_date=None, key="project_key", run_id=None):
        """Append raw records as JSON. A run with an id replaces what it wrote before."""
        return self._write(df, self.path(_tier("bronze", run_id), source), "json", run_date, key, run_id)

    def write_silver(self, df, source, run_date=None, key="project_key", json_text=False, run_id=None):
        """Append sanitized records; nested columns stay nested unless JSON text is asked for."""
        df = nested_to_json(df) if json_text else df
        return self._write(df, self.path(_tier("silver", run_id), source), "parquet", run_date, key, run_id)

    def write_gold(self, df, feature_set=fv.DEFAULT_FEATURE_SET, run_date=None, key="project_key", run_id=None):
        """Store a feature set, all projects in one write.

        Without a run id rows are appended. A run with an id has a folder of its own in
        each project and date; written again it replaces what it stored there before,
        and readers take one run of each project and date, the one whose id sorts last.
        """
        if run_id is None:
            return self._write(df, self.path("gold", feature_set), "parquet", run_date, key)
        path = self.path(_tier("gold", run_id), feature_set)
        schema_union.record(*self._files(path), path, df.schema)
        day = F.date_format(moment(run_date), "yyyy-MM-dd")
        placed = df.withColumns({"project": F.col(key), "date": day, _RUN: F.lit(run_id)}).hint("rebalance", "project")
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        with brief_shuffles(df.sparkSession):
            writer.partitionBy(*_PARTITIONS, _RUN).option("compression", "snappy").parquet(path)
        return path

    def newest_runs(self, feature_set=fv.DEFAULT_FEATURE_SET, projects=None, date=None):
        """The folders of the runs that readers take: of each project and date the one that sorts last.

        Folders are listed, as any reader of a partitioned table does; no file is opened.
        """
        base = self.path(_tier("gold", True), feature_set)
        filesystem, pattern = _filesystem(self.spark, f"{base}/project=*/date={date or '*'}/{_RUN}=*")
        wanted = None if projects is None else {projects} if isinstance(projects, str) else set(projects)
        newest = {}
        for status in filesystem.globStatus(pattern) or []:
            folder = status.getPath()
            place = folder.getParent()
            project = unquote(place.getParent().getName().removeprefix("project="))
            if wanted is None or project in wanted:
                run = unquote(folder.getName().removeprefix(f"{_RUN}="))
                newest[place.toString()] = max(newest.get(place.toString(), ("", "")), (run, folder.toString()))
        return [folder for _, folder in newest.values()]

    def _read_runs(self, tier, name, file_format, schema, projects, date, merge_schema):
        """Rows appended without a run id and rows of runs, which lie apart."""
        plain, runs = self.path(tier, name), self.path(_tier(tier, True), name)
        if not path_exists(self.spark, runs):
            return self._read(plain, file_format, schema, projects, date, merge_schema)
        found = self._read(runs, file_format, schema, projects, date, merge_schema).drop(_RUN)
        if not path_exists(self.spark, plain):
            return found
        appended = self._read(plain, file_format, schema, projects, date, merge_schema)
        return appended.unionByName(found, allowMissingColumns=True)

    def _united(self, reader, path):
        """The reader with the union of all schemas written to a table."""
        if path_exists(self.spark, f"{path}/{schema_union.LOG}"):
            return reader.schema(_with_partitions(schema_union.union_of(schema_union.recorded(self.spark, path))))
        return reader.option("mergeSchema", True)  # files of other writers: Spark reads all their footers

    def _read(self, path, file_format, schema, projects, date, merge_schema, folders=None):
        if not path_exists(self.spark, path) or folders == []:
            if schema is None:
                raise FileNotFoundError(f"nothing under {path}, and no schema for an empty table")
            return self.spark.createDataFrame([], _with_partitions(schema))
        reader = self.spark.read.format(file_format)
        if folders is not None:
            reader = reader.option("basePath", path)
        if schema is not None:
            reader = reader.schema(_with_partitions(schema))
        elif file_format == "parquet" and merge_schema:
            reader = self._united(reader, path)
        df = reader.load(path if folders is None else folders)
        if projects is not None:
            names = [projects] if isinstance(projects, str) else list(projects)
            df = df.where(F.col("project").isin(*names))
        if date is not None:
            df = df.where(F.col("date") == date)
        return df

    def read_bronze(self, source, schema, projects=None, date=None):
        return self._read_runs("bronze", source, "json", schema, projects, date, False)

    def read_silver(self, source, projects=None, date=None, schema=None, merge_schema=True, newest_only=False):
        """Silver rows of some projects and a date; the filters prune partitions.

        Re-ingested tickets are all there unless `newest_only` asks for one version each.
        """
        rows = self._read_runs("silver", source, "parquet", schema, projects, date, merge_schema)
        return latest(rows) if newest_only else rows

    def read_gold(self, feature_set=fv.DEFAULT_FEATURE_SET, projects=None, date=None, schema=None, merge_schema=True):
        """Rows appended without a run id, and of each project and date those of its newest run.

        Columns of all files are there, null where a file has none, in the widest
        of their types; types without a common one raise SchemaConflict.
        """
        plain, runs = self.path("gold", feature_set), self.path(_tier("gold", True), feature_set)
        folders = self.newest_runs(feature_set, projects, date)
        if not folders:
            return self._read(plain, "parquet", schema, projects, date, merge_schema)
        found = self._read(runs, "parquet", schema, projects, date, merge_schema, folders).drop(_RUN)
        if not path_exists(self.spark, plain):
            return found
        appended = self._read(plain, "parquet", schema, projects, date, merge_schema)
        return appended.unionByName(found, allowMissingColumns=True)

    def training_tickets(self, source, projects, schema=None):
        """The newest version of each silver ticket of several projects; an error where there are none."""
        tickets = self.read_silver(source, projects, schema=schema, newest_only=True)
        if tickets.isEmpty():
            raise ValueError("No training data available in the Silver layer")
        return tickets

    def append_feedback(self, feedback, as_of=None):
        """Validate feedback, append the valid rows, return (valid, rejected)."""
        kind = F.coalesce("feedback_type", F.lit(fv.DEFAULT_FEEDBACK_TYPE))
        stamped = feedback.withColumns({"feedback_type": kind, "timestamp": iso_text(moment(as_of))})
        valid, rejected = split_feedback(stamped)
        self.write_bronze(valid, "feedback", as_of)
        return valid, rejected

    def expire_bronze(self, as_of, days=fv.BRONZE_RETENTION_DAYS):
        """Delete bronze date folders older than `days` before `as_of` (a date)."""
        oldest = (as_of - timedelta(days=days)).isoformat()
        dropped = []
        filesystem, pattern = _filesystem(self.spark, f"{self.root}/bronze/*/project=*/date=*")
        _, of_runs = _filesystem(self.spark, f"{self.root}/{_tier('bronze', True)}/*/{_RUN}=*/project=*/date=*")
        for status in [*(filesystem.globStatus(pattern) or []), *(filesystem.globStatus(of_runs) or [])]:
            folder = status.getPath()
            if folder.getName().removeprefix("date=") < oldest:
                filesystem.delete(folder, True)
                dropped.append(folder.toString())
        return sorted(dropped)

    def save_baseline(self, profile, version="latest"):
        """Store a feature profile under a version, replacing only that version."""
        path = self.path("models", "baseline_stats")
        stamped = profile.withColumn("version", F.lit(version)).coalesce(1)  # one row per feature
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
        return path

    def load_baseline(self, version="latest"):
        stored = self.spark.read.parquet(self.path("models", "baseline_stats"))
        return stored.where(F.col("version") == version).drop("version")

    def append_alerts(self, alerts, run_id=None):
        """Append alerts; those of a run with an id replace what it stored before."""
        path, run = self.path("gold", "alerts"), F.lit(run_id or uuid.uuid4().hex)
        writer = alerts.withColumn(_RUN, run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("alert_type", _RUN).parquet(path)
        return path

    def read_alerts(self):
        path = self.path("gold", "alerts")
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], ALERT)
        return self.spark.read.schema(ALERT).parquet(path).select(*ALERT.fieldNames())

    def save_state(self, state):
        """Add marks; each write is a folder of its own, so loads at the same time keep each other's."""
        marks = state.where(F.col("last_ingest_date").isNotNull()).withColumn(_RUN, F.lit(new_run_id()))
        marks.write.mode("append").partitionBy(_RUN).parquet(self.path("state", "marks"))

    def load_state(self):
        """The furthest mark of every project over all that was ever saved; none before the first.

        Marks only grow, so the order in which loads saved them does not matter.
        """
        path = self.path("state", "marks")
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], STATE)
        mark = F.col("last_ingest_date")
        furthest = F.coalesce(F.max_by(mark, mark.try_cast("timestamp")), F.max(mark))
        return self.spark.read.schema(STATE).parquet(path).groupBy("project_key").agg(furthest.alias("last_ingest_date"))

    def compact_state(self):
        """Replace the marks saved so far by their furthest; folders that appear meanwhile stay."""
        filesystem, pattern = _filesystem(self.spark, f"{self.path('state', 'marks')}/{_RUN}=*")
        old = [status.getPath() for status in filesystem.globStatus(pattern) or []]
        if old:
            self.save_state(self.load_state())  # before the old ones go: a failure between leaves both
            for folder in old:
                filesystem.delete(folder, True)

def split_feedback(feedback):
    """(valid, rejected) feedback by project key and type."""
    good = is_project_key(F.col("project_key")) & F.coalesce(
        F.coalesce("feedback_type", F.lit(fv.DEFAULT_FEEDBACK_TYPE)).isin(*fv.FEEDBACK_TYPES), F.lit(False)
    )
    return feedback.where(good), feedback.where(~good)


def _with_partitions(schema):
    known = {field.name for field in schema.fields}
    extra = [T.StructField(name, T.StringType()) for name in _PARTITIONS if name not in known]
    return T.StructType([*schema.fields, *extra])

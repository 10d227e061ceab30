"""Registration of lake tables in the session catalog."""

from urllib.parse import unquote

from pyspark.sql.types import _parse_datatype_string

from lateline.sources.schema_union import SchemaConflict


def register_table(spark, database, name, path, columns, partitions=(), added=None):
    """Create or update an external, partitioned Parquet table.

    `columns` and `partitions` are (name, type) pairs. A table that exists is changed in
    place, so readers see it all the time: columns it lacks are added, columns no longer
    named stay, and one of another type is a SchemaConflict. Partitions the catalog does
    not know are added; `added` names them (one tuple of values each) where the caller knows
    what was written, else the folders are listed and those known are left out. A table of
    this name at another place is replaced.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    table = f"`{database}`.`{name}`"
    if spark.catalog.tableExists(f"{database}.{name}") and _location(spark, table) != _qualified(spark, path):
        spark.sql(f"DROP TABLE {table}")  # the name of another table; dropping it leaves its files alone
    if not spark.catalog.tableExists(f"{database}.{name}"):
        described = ", ".join(f"`{column}` {kind}" for column, kind in [*columns, *partitions])
        by = f"PARTITIONED BY ({', '.join(f'`{column}`' for column, _ in partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE {table} ({described}) USING parquet {by} LOCATION '{path}'")
    else:
        _add_columns(spark, table, columns)
    if partitions:
        _add_partitions(spark, table, path, [column for column, _ in partitions], added)
    return spark.table(table)


def _qualified(spark, path):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(location).toString().rstrip("/")


def _location(spark, table):
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
    return _qualified(spark, described["data_type"])


def _add_columns(spark, table, columns):
    known = {field.name.lower(): field.dataType for field in spark.table(table).schema.fields}
    new = []
    for column, kind in columns:
        before = known.get(column.lower())
        if before is None:
            new.append(f"`{column}` {kind}")
        elif before != _parse_datatype_string(kind):
            raise SchemaConflict(f"column {column} of {table} is {before.simpleString()}, not {kind}")
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(new)})")


def _add_partitions(spark, table, path, names, added):
    known = {tuple(unquote(part.split("=", 1)[1]) for part in row[0].split("/")) for row in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    found = set(map(tuple, added)) if added is not None else _folders(spark, path, names)
    for values in sorted(found - known):
        spec = ", ".join(f"`{column}` = '{_quoted(value)}'" for column, value in zip(names, values, strict=True))
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({spec})")


def _folders(spark, path, names):
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path("/".join([path, *[f"{column}=*" for column in names]]))
    found = set()
    for status in pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        parts = status.getPath().toString().split("/")[-len(names) :]
        found.add(tuple(unquote(part.split("=", 1)[1]) for part in parts))
    return found


def _quoted(value):
    return value.replace("\\", "\\\\").replace("'", "\\'")

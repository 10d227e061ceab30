"""What the corpus operators share."""

from lateline.session import prepare

SPACE = " \t\n\x0b\x0c\r"  # the six ASCII white-space characters that part words
# Python workers get batches bounded in rows and bytes, so a run of very long texts stays small
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def ready(spark):
    """The session with the settings the operators count on."""
    prepare(spark)
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    return spark


def table(spark, sf_dir, name):
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df, name):
    """`name`, with underscores put before it until no column of `df` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_batches(df, function, schema):
    """mapInArrow for a function from one record batch to one or more record batches."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def byte_values(column):
    """A string column of a record batch as bytes objects (None for null)."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()

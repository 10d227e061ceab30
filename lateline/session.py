"""Session set-up."""

from pyspark.sql import SparkSession

# runtime settings the operators count on
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name="lateline", master=None, **settings):
    """A session with our runtime settings. Without a master the cluster's own is used."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark):
    """Apply the runtime settings to a session somebody else built."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark

"""Session construction and the session settings every operator relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change answers or plans. Timestamps carry no zone in the data, so the
# session zone is pinned; ANSI stays on (operators use try_* where input may be bad);
# AQE re-plans joins from runtime sizes and splits skewed partitions.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def configure_once(spark: SparkSession) -> SparkSession:
    """:func:`configure`, the first time a session is seen; later changes by the caller stay."""
    if spark.conf.get("cohortscope.configured", None) is None:
        configure(spark)
        spark.conf.set("cohortscope.configured", "true")
    return spark


def build_session(
    master: str = "local[*]",
    app_name: str = "cohortscope",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings above. The web UI stays off.

    ``shuffle_partitions`` is for small local runs; by default Spark's own setting holds.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SQL_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present and point at shared storage. Only tests
    pass ``fallback`` (a scratch folder) for a session where it is unset.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    target = configured or fallback
    if not target:
        raise RuntimeError("spark.checkpoint.dir is not set for this session")
    spark.sparkContext.setCheckpointDir(target)
    return spark.sparkContext.getCheckpointDir()

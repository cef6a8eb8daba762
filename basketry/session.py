"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings. All can be changed on a live session, so they can also
# be applied to a session somebody else created.
SETTINGS = {
    # Timestamps are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan at run time: merge small shuffle partitions, split skewed ones,
    # switch to a broadcast join only when the measured size allows it.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more (pre-aggregated)
    # shuffle afterwards: one key may hold a large part of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


#: Shuffle partitions to start from on a cluster. AQE merges those that turn out small
#: but splits no aggregate's partition, so the number must suit the largest shuffle.
CLUSTER_PARTITIONS = 4000


def apply_settings(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to an existing session and return it.

    On a cluster shuffles start from :data:`CLUSTER_PARTITIONS` partitions, unless the
    session names a number itself; a local session keeps ``spark.sql.shuffle.partitions``.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    local = spark.conf.get("spark.master", "").startswith("local")
    if not local and spark.conf.get(initial, None) is None:
        more = max(CLUSTER_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.conf.set(initial, str(more))
    return spark


def shuffle_partitions(input_bytes: int, target_bytes: int = 128 * 1024**2) -> int:
    """Initial shuffle partition count that keeps partitions near ``target_bytes``.

    AQE only merges partitions that turn out small, so the initial number has to
    be high enough for the largest shuffle of a job.
    """
    return max(200, -(-input_bytes // target_bytes))


def build_session(
    app_name: str = "basketry",
    master: str | None = None,
    options: dict[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """Create (or get) a session with the library's settings.

    ``master`` is left to the launcher unless given, as in local tests.
    ``input_bytes``, the size of the tables, sizes the initial shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        partitions = shuffle_partitions(input_bytes)
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SETTINGS, **(options or {})}.items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())

"""Session settings the operators count on, and the bounds they read.

None of them changes a result.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# A case with at least this many events is spread over several tasks.
HOT_CASE_EVENTS = "spark.casewright.hotCaseEvents"
HOT_CASE_EVENTS_DEFAULT = 1_000_000

# Events of ordinary cases that one task puts in order, about. Logs that make more such
# tasks than run at once are dealt into as many, whatever Spark would choose.
TASK_EVENTS = "spark.casewright.taskEvents"
TASK_EVENTS_DEFAULT = 250_000

# Most rows that a net, or the flow counts of one discovery step, may have to be
# walked through on the driver and in Python tasks. Graphs have no such bound.
MODEL_CELLS = "spark.casewright.modelCells"
MODEL_CELLS_DEFAULT = 5_000_000


def setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def build_session(app_name: str = "casewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skewed-join splitting on.

    Memory, parallelism and the checkpoint folder are the cluster's business
    and are left alone unless passed in ``conf`` (dots as in Spark's own keys).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Checkpoints go when what they hold is no longer referred to.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

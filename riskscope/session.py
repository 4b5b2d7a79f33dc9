"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "riskscope", shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session.  ``master`` is only set when given, so a
    cluster launcher's settings win.  The UI is off: no web server."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Broadcast only what the planner can prove small.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to shared storage and we only read
    it (Spark registers it with the context at start-up).  Where nothing is
    set, a local session gets one scratch folder, registered with the context
    once, so ``DataFrame.checkpoint()`` works; any other master is refused.
    The setting itself is never changed at runtime.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # pragma: no cover - Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover
            d = None
    if not d:
        d = _local_fallback(sc.master)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


_FALLBACK_DIR: str | None = None


def _local_fallback(master: str) -> str:
    """A scratch folder of this machine, for local sessions alone: elsewhere
    the driver and the executors would each see their own."""
    global _FALLBACK_DIR
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set: master {master} needs a folder that all executors share")
    if _FALLBACK_DIR is None:
        _FALLBACK_DIR = tempfile.mkdtemp(prefix="riskscope-ckpt-")
    return _FALLBACK_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and read it back (cuts
    lineage; survives executor loss, unlike a local checkpoint).

    Use it between the classification and anything that *filters* on its
    derived columns: Catalyst pushes a filter below the projections by
    substituting each column with its defining expression, so a predicate on
    ``requires_human_review`` would inline the whole cleaning and rule chain
    once per reference.  Production jobs write the results table instead.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

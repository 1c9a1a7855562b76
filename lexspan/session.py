"""Session helpers: settings the operators rely on, and durable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None, app: str = "lexspan") -> SparkSession:
    """Session for tests and benches; a cluster job passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # join by hash instead of sorting wherever every partition is measured to fit
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        # partitions of a megabyte keep eight cores busy only on larger tables
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set in code.

    Where neither is set, a session on one machine (tests) gets a temporary folder; on a cluster that
    would be each machine's own disk, so it is an error there.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names (see ``shared_root``)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    import pathlib
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="spark-pkg-")) / "lexspan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows over the cores if the source has fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def by_rows(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Hash rows over as many partitions as give each about ``rows`` of them, unless the source has that many splits.

    For work that is heavy for its bytes: a table of a few files gives a few splits at any size, so their tasks
    would grow with the table. The count reads a Parquet table's footers only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(cores, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *keys)


def by_id(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Hash rows by a key into partitions of about ``rows``: what is grouped by the key after it needs no shuffle."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, key)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by keys into the full number of partitions.

    For steps whose work per byte is high: a partition count given explicitly is
    kept, where adaptive execution would merge partitions by their small size."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)

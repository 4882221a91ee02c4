"""Session for tests and the bench, and staging of tables between jobs."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", **conf) -> SparkSession:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("deskloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session, as in tests, gets one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="deskloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application in the shared folder, for intermediate tables."""
    return f"{shared_folder(spark)}/deskloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back; options are those of the writer.

    Cuts the lineage: a lost executor costs a re-read, not a re-run. The table
    stays until discard, as results may still be read from it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_in = path
    return staged


def hand_over(staged: DataFrame, folder: str) -> bool:
    """Make a staged table the table of a folder that isn't there yet, without writing it again.

    Nothing can be read from the staged table afterwards. False, and nothing done,
    if the table isn't one that stage wrote, or the folder is in another file system.
    """
    path = getattr(staged, "staged_in", None)
    if not isinstance(path, str):
        return False
    spark = staged.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.Path(path), hadoop.Path(folder)
    system = source.getFileSystem(conf)
    if not system.getUri().equals(target.getFileSystem(conf).getUri()) or system.exists(target):
        return False
    system.mkdirs(target.getParent())
    return system.rename(source, target)


def discard(spark: SparkSession) -> None:
    """Remove all tables this application has staged. Results that are not
    written yet cannot be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/deskloom-{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by key into as many parts as a shuffle makes.

    For a caller who knows that the input is a few files that would otherwise
    keep all work in a few tasks; a large input needs no such shuffle.
    """
    return df.repartition(*keys)

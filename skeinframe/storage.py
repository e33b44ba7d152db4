"""Written tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one of this machine, if the master is local, too."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _own.get(sc.applicationId)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="skeinframe-shared-")
    return where.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/skeinframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more; what was made from them must have been settled itself."""
    for table in tables:
        if path := getattr(table, "settled_at", None):
            jvm = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(jvm, True)

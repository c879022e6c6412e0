"""Scratch space of one application in the cluster's shared folder.

Tables and files that operators write for themselves lie in one namespace, whose folder
``clear_scratch`` removes when no frame needs them any more.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from gridlark.session import scratch_root
from gridlark.sources.seed import ensure_namespace


def _own_name(spark: SparkSession) -> str:
    return "gridlark_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)


def scratch_namespace(spark: SparkSession, name: str | None = None) -> str:
    """A namespace in the shared folder; without a name the application's own."""
    name = name or _own_name(spark)
    ensure_namespace(spark, name, f"{scratch_root(spark)}/{name}")
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's scratch folder; every call returns another one."""
    return f"{scratch_root(spark)}/{_own_name(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application wrote into its scratch space."""
    spark.sql(f"DROP NAMESPACE IF EXISTS {scratch_namespace(spark)} CASCADE")

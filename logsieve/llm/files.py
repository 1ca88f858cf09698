"""Binary files in the cluster's shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from logsieve.sources.sinks import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder URI under the shared folder that nothing else uses."""
    root = shared_dir(spark)
    if "://" not in root and root.startswith("file:"):
        root = root.replace("file:", "file://", 1)
    elif "://" not in root:
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A name for one attempt of one task. The manifest tells which attempt counts."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"

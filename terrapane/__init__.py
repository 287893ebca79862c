"""Spark-first analytics over gridded embedding tiles."""

from __future__ import annotations

import os

__version__ = "0.1.0"


def reachable() -> None:
    """Let Python workers import this package wherever the driver found it.

    Functions are sent to workers by name. Workers started by a JVM that is yet
    to come inherit the path; those of a running context get it with each
    function.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    def added(path: str | None) -> str:
        parts = [p for p in (path or "").split(os.pathsep) if p]
        return os.pathsep.join(parts if root in parts else [root, *parts])

    os.environ["PYTHONPATH"] = added(os.environ.get("PYTHONPATH"))
    from pyspark import SparkContext

    if (context := SparkContext._active_spark_context) is not None:
        context.environment["PYTHONPATH"] = added(context.environment.get("PYTHONPATH"))


reachable()

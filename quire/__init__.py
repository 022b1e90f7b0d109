"""quire: search, ranking and curation of document libraries on Spark DataFrames."""

from __future__ import annotations

import os

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it (a shared folder, or one machine)."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, HOME])

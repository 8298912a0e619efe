"""This package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application; its archive goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(package):
            top, name = os.path.split(package)
            folder = tempfile.mkdtemp()
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", top, name))
        _shipped.add(app)

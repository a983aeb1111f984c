"""Photo files, one folder per SKU: ``<root>/<sku>/<file>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.functions.fixed_values import PHOTO_EXTENSIONS


def list_photo_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the photo files below ``root``. Only names are read, never the images.

    Spark keeps one status per file on the driver while it lists. For a store of many millions
    of files give :func:`rackwise.operators.photos.photo_inventory` a table of paths instead,
    such as the inventory report object stores write.
    """
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(PHOTO_EXTENSIONS) + "}")
        .load(root).select(F.col("path"))
    )

"""Listing of image files in a folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgauge.operators.blocks import asset_names


def list_assets(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg"), skip: tuple[str, ...] = ()
) -> DataFrame:
    """Path, folder and file of every image below ``root``; the bytes are never read."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "modificationTime", "length")
    )
    return asset_names(listing, "path", extensions, skip)

"""Data-set, country and device dimensions and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.fixed_values import ALIAS_SPELLING, DEVICE_COUNTRIES, SUBSETS


def subset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SUBSETS), "alias string, sector string, country string, present boolean")


def device_table(spark: SparkSession) -> DataFrame:
    rows = [(d, c) for d, cs in DEVICE_COUNTRIES.items() for c in cs]
    return spark.createDataFrame(rows, "device int, country string")


def fix_alias(df: DataFrame, column: str = "alias") -> DataFrame:
    c = F.col(column)
    out = c
    for wrong, right in ALIAS_SPELLING.items():
        out = F.when(c == wrong, F.lit(right)).otherwise(out)
    return df.withColumn(column, out)


def country_groups(subsets: DataFrame) -> DataFrame:
    """Country -> group "sector/alias", only where data is present."""
    return subsets.where("present").select("country", F.concat_ws("/", "sector", "alias").alias("grp"))


def device_groups(subsets: DataFrame, devices: DataFrame) -> DataFrame:
    return devices.join(country_groups(subsets), "country").select("device", "country", "grp")


def checks(subsets: DataFrame, devices: DataFrame) -> DataFrame:
    """Countries in several devices, with data but no device, or in a device but without data."""
    present = subsets.where("present").select("country").distinct()
    held = devices.select("country").distinct()
    twice = devices.groupBy("country").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("country")
    tag = lambda d, name: d.select(F.lit(name).alias("problem"), "country")
    return (
        tag(twice, "duplicate")
        .unionByName(tag(present.exceptAll(held), "missing"))
        .unionByName(tag(held.exceptAll(present), "extra"))
    )


def device_of(countries: DataFrame, devices: DataFrame) -> DataFrame:
    """Device of each country, 0 when none holds it."""
    return countries.join(devices, "country", "left").withColumn("device", F.coalesce("device", F.lit(0)))


def preflight(items: DataFrame, devices: DataFrame) -> DataFrame:
    """Items per device and split; a device without train or test items is an error.

    ``items``: grp, split; ``devices``: device, grp.
    """
    counts = items.groupBy("grp", "split").agg(F.count(F.lit(1)).alias("c"))
    found = counts.join(devices, "grp").groupBy("device", "split").agg(F.sum("c").alias("items"))
    spine = devices.select("device").distinct().select(
        "device", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split")
    )
    return spine.join(found, ["device", "split"], "left").select(
        "device", "split", F.coalesce("items", F.lit(0)).alias("items"), (F.coalesce("items", F.lit(0)) == 0).alias("error")
    )


def balance(volumes: DataFrame, devices: DataFrame, cap: int) -> DataFrame:
    """Volume per device, share of the largest one, and whether the cap is passed.

    ``volumes``: grp, windows; ``devices``: device, grp.
    """
    per = volumes.join(devices, "grp").groupBy("device").agg(F.sum("windows").alias("windows"))
    top = per.agg(F.max("windows")).scalar()
    total = per.agg(F.sum("windows")).scalar()
    return per.select(
        "device", "windows", (F.col("windows") / total).alias("share"),
        (F.col("windows") / top).alias("of_largest"), (F.col("windows") > cap).alias("over_cap"),
    )

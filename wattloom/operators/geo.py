"""Map data: exclusion, coordinates, grouping and bubble weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.fixed_values import ISO_COORDS, PLACE_COORDS
from wattloom.functions.scalars import loose_number


def exclude(df: DataFrame, absent: Sequence[str]) -> DataFrame:
    return df.where(~F.coalesce(F.col("alias").isin(list(absent)), F.lit(False)))


def excluded_total(df: DataFrame, absent: Sequence[str], obs: str = "n_obs") -> DataFrame:
    """How many rows the exclusion drops and how many observations they hold."""
    return df.where(F.col("alias").isin(list(absent))).agg(
        F.count(F.lit(1)).alias("excluded"), F.coalesce(F.sum(F.coalesce(loose_number(F.col(obs)), F.lit(0.0))), F.lit(0.0)).alias("excluded_obs")
    )


def coordinates(
    location: Column, iso: Column,
    places: Mapping[str, tuple[float, float]] = PLACE_COORDS,
    countries: Mapping[str, tuple[float, float]] = ISO_COORDS,
) -> Column:
    """struct(lat, lon): first place name contained in the location, else the country, else null."""
    loc, code = F.lower(F.trim(location)), F.upper(F.trim(iso))
    pair = lambda p: F.struct(F.lit(float(p[0])).alias("lat"), F.lit(float(p[1])).alias("lon"))
    out = None
    for name, p in places.items():
        hit = loc.contains(name)
        out = F.when(hit, pair(p)) if out is None else out.when(hit, pair(p))
    for name, p in countries.items():
        hit = code == name
        out = F.when(hit, pair(p)) if out is None else out.when(hit, pair(p))
    return out


def geocode(df: DataFrame, places=PLACE_COORDS, countries=ISO_COORDS) -> DataFrame:
    return df.withColumn("__c", coordinates(F.col("location"), F.col("iso"), places, countries)).select(
        *df.columns, F.col("__c.lat").alias("lat"), F.col("__c.lon").alias("lon")
    )


def not_located(geocoded: DataFrame) -> DataFrame:
    return geocoded.where(F.col("lat").isNull()).select("alias", "location", "iso")


def by_location(geocoded: DataFrame) -> DataFrame:
    """Sums per place with the joined aliases."""
    valid = geocoded.where(F.col("lat").isNotNull() & F.col("n_obs").isNotNull())
    return valid.groupBy("location", "iso", "lat", "lon").agg(
        F.sum("n_obs").alias("n_obs"), F.sum("n_buildings").alias("n_buildings"),
        F.count("alias").alias("n_datasets"),
        F.array_join(F.array_sort(F.collect_list("alias")), "; ").alias("datasets"),
    )


def jitter(df: DataFrame, key: str, reach: float = 2.5) -> DataFrame:
    """Rows that share their coordinates move by up to ``reach`` degrees, repeatably."""
    crowd = df.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("__n"))

    def shift(salt: str) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key), F.lit(salt))), 1, 8), 16, 10).cast("double")
        return (h / float(2**32) * 2 - 1) * reach

    moved = F.col("__n") > 1
    return df.join(crowd, ["lat", "lon"]).withColumns(
        {
            "lat": F.when(moved, F.col("lat") + shift("lat")).otherwise(F.col("lat")),
            "lon": F.when(moved, F.col("lon") + shift("lon")).otherwise(F.col("lon")),
        }
    ).drop("__n")


def bubble_weight(df: DataFrame, scale: str = "log", largest: float = 2500.0) -> DataFrame:
    """Area and colour of a bubble from its observations, relative to the largest one."""
    w = F.log10(F.greatest(F.col("n_obs"), F.lit(1.0))) if scale == "log" else F.col("n_obs")
    weighted = df.withColumn("__w", w)
    top = weighted.agg(F.max("__w")).scalar()
    return weighted.withColumn("area", F.lit(largest) * F.pow(F.col("__w") / top, 2) + 15).withColumn(
        "colour", F.log10(F.greatest(F.col("n_obs"), F.lit(1.0)))
    ).drop("__w")


def root_weight(df: DataFrame, largest: float = 3500.0, smallest: float = 30.0) -> DataFrame:
    """Area by the square root of the share of the largest."""
    top = df.agg(F.max("n_obs")).scalar()
    return df.withColumn("area", F.lit(smallest) + F.lit(largest) * F.sqrt(F.col("n_obs") / top))

"""Places: names in table order, geocoding of location text, and suggestions while typing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import fold, match_rank, title_case


def read_places(spark, path: str) -> DataFrame:
    """A pipe-separated gazetteer of name, country, region, lat, lon, alternative names; comments, blanks and rows of other widths are left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    p = F.split("value", r"\|", -1)
    ok = lines.where(F.size(p) == 6)
    name = lambda k: F.nullif(F.trim(F.get(p, F.lit(k))), F.lit(""))
    return ok.select(name(0).alias("city"), F.upper(name(1)).alias("country_code"), name(2).alias("region"), name(3).cast("double").alias("lat"), name(4).cast("double").alias("lon"), name(5).alias("alt_names"))


def city_names(places: DataFrame) -> DataFrame:
    """(name, ord, country_code, region, city, lat, lon): every folded name of every city; ord is the table's order."""
    c = places.where("city is not null")
    names = F.concat(F.array("city"), F.coalesce(F.split("alt_names", ","), F.array().cast("array<string>")))
    return c.select(F.explode(names).alias("n"), F.col("place_id").alias("ord"), "country_code", "region", "city", "lat", "lon").select(fold("n").alias("name"), "ord", "country_code", "region", "city", "lat", "lon")


def country_names(places: DataFrame) -> DataFrame:
    """(name, country_code): code, name and alternative names of each country, folded."""
    c = places.where("city is null")
    names = F.concat(F.array("country_name", "country_code"), F.coalesce(F.split("alt_names", ","), F.array().cast("array<string>")))
    return c.select(F.explode(names).alias("n"), "country_code").select(fold("n").alias("name"), "country_code")


def geocode(texts: DataFrame, places: DataFrame, column: str = "location") -> DataFrame:
    """(location, city, region, country_code, lat, lon) of each different text that names a place, by exact names.

    The text's parts are looked up by equality: the first country named, then the first part that's a city in it (or of any
    country, the most prominent, where none is named); else the country alone.
    """
    t = texts.select(F.col(column).alias("location")).where("location is not null").distinct()
    marked = F.regexp_replace("location", " [-–] ", ",")
    parts = t.select("location", F.posexplode(F.split(marked, r"[,|/;()·]")).alias("pos", "p")).select("location", "pos", fold("p").alias("name")).where("name <> ''")
    land = parts.join(country_names(places), "name").groupBy("location").agg(F.min_by("country_code", F.struct("pos", "country_code")).alias("land"))
    hit = parts.join(city_names(places), "name").join(land, "location", "left").where("land is null or land = country_code")
    best = hit.groupBy("location").agg(F.min_by(F.struct("city", "region", "country_code", "lat", "lon"), F.struct("pos", "ord")).alias("c"))
    both = best.join(land, "location", "full")
    return both.select("location", "c.city", "c.region", F.coalesce("c.country_code", "land").alias("country_code"), "c.lat", "c.lon")


def find_place(places: DataFrame, text: str) -> dict | None:
    """Where one text is: a row's fields, or None. A single lookup on the driver."""
    row = geocode(places.sparkSession.createDataFrame([(text,)], "location string"), places).first()
    return row.asDict() if row and row.country_code else None


def suggest(places: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(value, kind, rank): what a typed beginning can mean; exact names, then beginnings, then later words; cities before countries, then table order."""
    q = " ".join(query.lower().split())
    limit = min(max(limit, 1), 20)
    if not q:
        return places.sparkSession.createDataFrame([], "value string, kind string, rank int")
    lands = places.where("city is null").select(F.col("country_code").alias("cc"), F.col("country_name").alias("land"))
    cities = city_names(places).withColumn("rank", match_rank("name", F.lit(q))).where("rank is not null").groupBy("ord", "city", "country_code").agg(F.min("rank").alias("rank"))
    c = cities.join(lands, F.col("country_code") == F.col("cc"), "left").select(F.concat("city", F.lit(", "), F.coalesce(title_case("land"), "country_code")).alias("value"), F.lit("city").alias("kind"), "rank", "ord")
    names = country_names(places).where(F.length("name") > 2).withColumn("rank", match_rank("name", F.lit(q))).where("rank is not null").groupBy("country_code").agg(F.min("rank").alias("rank"))
    k = names.join(places.where("city is null").select("country_code", "country_name", F.col("place_id").alias("ord")), "country_code").select(F.col("country_name").alias("value"), F.lit("country").alias("kind"), "rank", "ord")
    return c.unionByName(k).orderBy("rank", "kind", "ord").limit(limit).select("value", "kind", "rank")

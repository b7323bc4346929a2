"""Slugs of all brands at once, no two alike.

Brands choose in the order of their revenue: the plain slug, else the first free one of slug-2, slug-3, ... Chosen in rounds
instead of one after the other: every brand asks for its next choice, each slug goes to the highest revenue that
asks for it, the others ask for the next one. As all slugs prefer brands in the same order, the rounds end with
what choosing in turn gives. Brands with one plain slug begin at their place among themselves, so rounds are only
spent on slugs that look like another's suffix.
"""
from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.clean import brand_slug
from tillpoint.plans.curate import materialize
from tillpoint.plans.prefix import global_running

#: Latin letters with accents, and the letters they come apart into.
_ACCENTED = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFKD", chr(c))) > 1}


def plain_slug(name) -> F.Column:
    """The slug of a name by itself, accents taken off."""
    return brand_slug(F.translate(F.lower(name), "".join(_ACCENTED), "".join(_ACCENTED.values())))


def brand_slugs(brands: DataFrame) -> DataFrame:
    """(name, slug) of the (name, revenue) of all brands; equal revenues choose by name."""
    spark = brands.sparkSession
    named = brands.where("name is not null").select("name", "revenue", plain_slug(F.col("name")).alias("base"))
    ranked = global_running(named, [F.desc("revenue"), F.col("name")], index_col="rank").select("name", "base", "rank")
    inside = Window.partitionBy("base").orderBy("rank")
    now = materialize(spark, ranked.withColumn("k", F.row_number().over(inside)).withColumn("choice", F.col("k")), "slugs", None)
    slug = F.when(F.col("choice") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("choice").cast("string")))
    while True:
        asked = now.withColumn("slug", slug)
        held = asked.groupBy("slug").agg(F.min("rank").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # a brand that loses asks for its next choice; those behind it with the same plain slug stay behind it
        lost = asked.join(held, "slug", "left").withColumn("choice", F.col("choice") + F.coalesce((F.col("rank") != F.col("holder")).cast("int"), F.lit(0)))
        ahead = F.max(F.col("choice") - F.col("k")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        new = materialize(spark, lost.select("name", "base", "rank", "k", (ahead + F.col("k")).cast("int").alias("choice"), F.col("choice").alias("was")), "slugs", None)
        if held.isEmpty():
            return asked.select("name", "slug")
        now = new.drop("was")

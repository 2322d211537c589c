"""Saved JSON of recognizers and of the media API, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbmark.functions.text import first_filled, strip, strip_tags

_OCR = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>,dt_polys:array<array<array<double>>>>"


def recognized_texts(rows: DataFrame, json: str = "json") -> DataFrame:
    """drawing_id, text_idx, text, quad, char_conf from one JSON text a drawing, its result at the top or below `res`."""
    whole = F.from_json(F.col(json), f"struct<res:{_OCR},rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>,dt_polys:array<array<array<double>>>>")
    of = lambda name: F.coalesce(F.col(f"_r.res.{name}"), F.col(f"_r.{name}"))
    polys = F.coalesce(of("rec_polys"), of("dt_polys"))
    parts = rows.withColumn("_r", whole).select("drawing_id", F.posexplode(F.arrays_zip(of("rec_texts").alias("text"), of("rec_scores").alias("score"), polys.alias("poly"))).alias("text_idx", "t"))
    quad = F.transform(F.coalesce("t.poly", F.array().cast("array<array<double>>")), lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    return parts.where("t.text IS NOT NULL").select("drawing_id", "text_idx", F.col("t.text").alias("text"), quad.alias("quad"), F.coalesce("t.score", F.lit(0.0)).alias("char_conf"))


def guard(drawings: DataFrame, texts: DataFrame) -> DataFrame:
    """drawing_id, n_texts, blank, diagnostic: why a drawing has no recognized text."""
    found = texts.groupBy("drawing_id").agg(F.count("*").alias("n_texts"), F.count_if(strip(F.col("text")) == "").alias("blank"))
    rows = drawings.join(found, "drawing_id", "left").na.fill(0, ["n_texts", "blank"])
    why = F.when(F.col("height") < 50, "image too small").when(F.col("n_texts") == 0, "no text found").when(F.col("blank") > 0, F.format_string("%d blank texts dropped", "blank"))
    return rows.select("drawing_id", "n_texts", "blank", why.alias("diagnostic"))


_INFO = "array<struct<url:string,descriptionshorturl:string,extmetadata:struct<License:struct<value:string>,LicenseShortName:struct<value:string>,Artist:struct<value:string>>>>"


def media_candidates(responses: DataFrame) -> DataFrame:
    """filename, url, license_raw, attribution, source_page_url from saved responses (status, body); others than 200 or bad JSON give no rows."""
    body = F.from_json("body", f"struct<query:struct<pages:map<string,struct<title:string,imageinfo:{_INFO}>>>>")
    pages = responses.where("status = 200").select(F.explode(F.map_values(body["query"]["pages"])).alias("p"))
    meta = lambda name: F.col("i.extmetadata")[name]["value"]
    rows = pages.select("p.title", F.get(F.col("p.imageinfo"), F.lit(0)).alias("i"))
    return rows.select(F.col("title").alias("filename"), "i.url", first_filled(meta("License"), meta("LicenseShortName")).alias("license_raw"), strip_tags(meta("Artist")).alias("attribution"), F.col("i.descriptionshorturl").alias("source_page_url"))

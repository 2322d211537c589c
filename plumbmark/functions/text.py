"""String functions of the corpus and of recognized text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed rules of the licence mapping: code (a final dash: any code that starts so) and category; the first that fits counts.
LICENSE_RULES = (
    ("cc-zero", "public"), ("cc0", "public"), ("public-domain", "public"), ("publicdomain", "public"), ("pd-", "public"), ("pd", "public"),
    ("cc-by-nc-sa-", "CC-BY-NC"), ("cc-by-nc-sa", "CC-BY-NC"), ("cc-by-nc-", "CC-BY-NC"), ("cc-by-nc", "CC-BY-NC"),
    ("cc-by-sa-", "CC-BY-SA"), ("cc-by-sa", "CC-BY-SA"), ("cc-by-", "CC-BY"), ("cc-by", "CC-BY"),
)
#: Fixed order in which a content type's words decide the extension.
CONTENT_TYPES = (("png", ".png"), ("jpeg", ".jpg"), ("jpg", ".jpg"), ("pdf", ".pdf"), ("svg", ".svg"))
#: Fixed patterns of recognized text; (?U) gives \d, \w and \s their Unicode meaning.
DIMENSION, ROOM = r"(?U)^\d{2,5}(\.\d+)?$", r"(?U)^[A-Za-zㄱ-힝][\wㄱ-힝\s]*$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def classify_text(text: Column) -> Column:
    """dimension_text, room_label or other; null is other."""
    own = strip(F.coalesce(text, F.lit("")))
    return F.when(own.rlike(DIMENSION), "dimension_text").when(own.rlike(ROOM), "room_label").otherwise("other")


def map_license(raw: Column) -> Column:
    """The category of a licence code, null if no rule fits: nothing is guessed."""
    key = F.lower(strip(raw))
    tests = [(key.startswith(code) if code.endswith("-") else key == code, category) for code, category in LICENSE_RULES]
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def safe_stem(title: Column) -> Column:
    """A file's title as a name of [a-z0-9_-], 80 characters at most; `untitled` if nothing is left."""
    bare = F.regexp_replace(title, r"(?i)^file:", "")
    name = F.regexp_replace(F.regexp_replace(bare, "/+$", ""), "^.*/", "")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    clean = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9_\-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(clean, "^_+|_+$", ""), 1, 80), F.lit("")), F.lit("untitled"))


def with_prefix(stem: Column, prefix: str = "wm_") -> Column:
    return F.when(stem.startswith(prefix), stem).otherwise(F.concat(F.lit(prefix), stem))


def infer_extension(url: Column, content_type: Column) -> Column:
    """From the content type, else from the URL's path, else .png."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[A-Za-z0-9]+)$", 1))
    from_path = F.when(suffix.isin(".png", ".jpg", ".pdf"), suffix).when(suffix == ".jpeg", ".jpg").otherwise(".png")
    return reduce(lambda rest, rule: F.when(F.contains(kind, F.lit(rule[0])), rule[1]).otherwise(rest), reversed(CONTENT_TYPES), from_path)


def strip_tags(html: Column) -> Column:
    """Text without tags, null if none is left."""
    return F.nullif(strip(F.regexp_replace(html, r"<[^>]+>", "")), F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def stem(path: Column) -> Column:
    """A path's file name without its last suffix."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def preview(text: Column, most: int) -> Column:
    """The first characters, with three dots where more follow."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def preview_status(exists: Column, suffix: Column) -> Column:
    """Why a file has no preview; null if it has one."""
    low = F.lower(suffix)
    return F.when(~exists, "file is missing").when(low == ".svg", "svg has no preview").when(~low.isin(".png", ".jpg", ".jpeg", ".pdf"), F.concat(F.lit("no preview of "), low))


def commercial_safe(license_: Column) -> Column:
    return license_.isin("CC-BY", "CC-BY-SA", "public")


def register(spark: SparkSession) -> None:
    """The text rules as SQL functions, for those who write SQL; plain expressions, so Catalyst still sees through them."""
    sql = " ".join(f"WHEN {'startswith(k, ' + repr(c) + ')' if c.endswith('-') else 'k = ' + repr(c)} THEN '{m}'" for c, m in LICENSE_RULES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION map_license(raw STRING) RETURNS STRING RETURN (SELECT CASE {sql} END FROM (SELECT lower(regexp_replace(raw, '(?U)^\\\\s+|\\\\s+$', '')) AS k))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION strip_tags(html STRING) RETURNS STRING RETURN nullif(trim(regexp_replace(html, '<[^>]+>', '')), '')")

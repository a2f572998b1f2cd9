"""The catalogs of published files: RSS feeds as DataFrames, dates and download plans."""

from __future__ import annotations

import os
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.vocab import check_version, check_zone, zone_name

# Where each generation's feed and files are.
FEEDS = {
    1: "https://opendata-movilidad.mitma.es/RSS.xml",
    2: "https://movilidad-opendata.mitma.es/RSS.xml",
}
FILE_ROOTS = {1: "https://opendata-movilidad.mitma.es", 2: "https://movilidad-opendata.mitma.es/estudios_basicos"}
RELATION_FILES = (
    "relacion_ine_zonificacionMitma.csv",
    "relaciones_municipio_mitma.csv",
    "relaciones_distrito_mitma.csv",
)
ITEMS = "title string, link string, pub_date string"


#: Some servers turn away clients that don't name themselves.
USER_AGENT = "Mozilla/5.0 (compatible; tesela)"
TIMEOUT_SECONDS = 120


def fetch_url(url: str) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
    with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as response:
        return response.read()


def feed_items(spark: SparkSession, xml: bytes | str) -> DataFrame:
    """title, link and pub_date of each item of one feed document."""
    root = ElementTree.fromstring(xml)
    rows = [tuple(item.findtext(t) for t in ("title", "link", "pubDate")) for item in root.iter("item")]
    return spark.createDataFrame(rows, ITEMS)


def file_name(link: Column) -> Column:
    return F.substring_index(link, "/", -1)


def year_month(name: Column) -> Column:
    head = F.substring(name, 1, 6)
    return F.when(head.rlike(r"^\d+$"), F.concat_ws("-", F.substring(head, 1, 4), F.substring(head, 5, 2)))


def year_month_day(name: Column) -> Column:
    day = F.substring(name, 7, 2)
    return F.when(day.rlike(r"^\d+$"), F.concat_ws("-", year_month(name), day)).otherwise(F.lit(None))


def extension(title: Column) -> Column:
    """What follows the first point; the whole title where there is none."""
    dot = F.instr(title, ".")
    return F.when(dot > 0, F.substring(title, dot + 1, F.length(title))).otherwise(title)


def mobility_catalog(items: DataFrame, version: int = 2, data_dir: str | None = None) -> DataFrame:
    """link, pub_date, file_extension, data_ym, data_ymd, local_path, downloaded for the files that show a month."""
    check_version(version)
    spark = items.sparkSession
    suffix = ".txt.gz" if version == 1 else ".csv.gz"
    names = sorted(os.listdir(data_dir)) if data_dir and os.path.isdir(data_dir) else []
    here = spark.createDataFrame([(n, os.path.join(data_dir, n)) for n in names], "found string, path string")
    name = file_name(F.col("link"))
    rows = items.select(
        "link",
        "pub_date",
        extension(F.col("title")).alias("file_extension"),
        year_month(name).alias("data_ym"),
        F.when(year_month(name).isNotNull(), year_month_day(name)).alias("data_ymd"),
        name.alias("raw"),
        F.concat(F.substring_index(name, ".", 1), F.lit(f"_v{version}{suffix}")).alias("own"),
    ).dropna(subset=["data_ym"])
    raw = here.select(F.col("found").alias("raw"), F.col("path").alias("raw_path"))
    own = here.select(F.col("found").alias("own"), F.col("path").alias("own_path"))
    rows = rows.join(F.broadcast(raw), "raw", "left").join(F.broadcast(own), "own", "left")
    return rows.withColumn("local_path", F.coalesce("raw_path", "own_path")).select(
        "link",
        "pub_date",
        "file_extension",
        "data_ym",
        "data_ymd",
        "local_path",
        F.col("local_path").isNotNull().alias("downloaded"),
    )


def zoning_pattern(zone: str | None = None) -> str:
    zones = zone or "municipios|distritos|gaus"
    return rf"^(zonificacion|poblacion|nombres)[_-]({zones})\..*$"


def zoning_catalog(items: DataFrame, version: int = 2, zone: str | None = None) -> DataFrame:
    """link, pub_date and filename of relation files and of the zone level's tables and shapes."""
    check_version(version)
    level = zone_name(check_zone(zone, version)) if zone is not None else None
    rows = items.select("link", "pub_date", file_name(F.col("link")).alias("filename"))
    return rows.where(F.col("filename").isin(*RELATION_FILES) | F.col("filename").rlike(zoning_pattern(level)))


def valid_dates(catalog: DataFrame) -> DataFrame:
    return catalog.select("data_ymd").dropna().distinct().orderBy("data_ymd")


def dates_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """data_ymd of every day from first to last, both included."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    return spark.range(1).select(days).select(F.date_format("day", "yyyy-MM-dd").alias("data_ymd"))


def download_plan(dates: DataFrame, dataset: str, zones: str, version: int) -> DataFrame:
    """data_ymd, url and file_name of a dataset's file for each date."""
    compact = F.translate("data_ymd", "-", "")
    month = F.substring("data_ymd", 1, 7)
    if version == 2:
        kind = f"{dataset}_dia" if dataset == "Personas" else dataset
        folder = f"{FILE_ROOTS[2]}/por-{zones}/{dataset.lower()}/ficheros-diarios/"
        tail = f"_{kind}_{zones}.csv.gz"
    else:
        folder = f"{FILE_ROOTS[1]}/{dataset}-mitma-{zones}/ficheros-diarios/"
        tail = f"_{dataset[:-1]}_{dataset[-1]}_mitma_{zones[:-1]}.txt.gz"
    suffix = "csv.gz" if version == 2 else "txt.gz"
    return dates.select(
        "data_ymd",
        F.concat(F.lit(folder), month, F.lit("/"), compact, F.lit(tail)).alias("url"),
        F.concat(compact, F.lit(f"_{dataset}_{zones}_v{version}.{suffix}")).alias("file_name"),
    )


def download(url: str, path: str, fetch: Callable[[str], bytes] = fetch_url) -> str:
    """Fetch url into path unless a file with content is there; nothing is left behind on failure or an empty body."""
    if os.path.exists(path) and os.path.getsize(path) > 0:
        return path
    if os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.part"
    try:
        body = fetch(url)
        if not body:
            raise OSError(f"{url} gave an empty body")
        with open(part, "wb") as f:
            f.write(body)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path

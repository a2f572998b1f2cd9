"""Writers of the standard tables and of zone geometries."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.sources.shapes import geometry_to_geojson


def table_name(dataset: str, zones: str, first: str, last: str, version: int) -> str:
    return f"{dataset}_{zones}_{first}_{last}_v{version}.parquet"


def save_table(df: DataFrame, path: str, by_date: bool = False, files: int | None = None) -> str:
    """Parquet folder at path, replaced; by_date makes a folder a date, which readers prune."""
    out = df.coalesce(files) if files else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy("date") if by_date else writer).parquet(path)
    return path


def save_geojson(zones: DataFrame, path: str, geometry: str = "geometry_wkb") -> str:
    """A FeatureCollection for other tools; zone tables have some thousands of rows, written one by one."""
    names = [c for c in zones.columns if c != geometry]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": [')
        for k, row in enumerate(zones.select(*names, F.col(geometry).alias("__shape")).toLocalIterator()):
            shape = row["__shape"] and geometry_to_geojson(bytes(row["__shape"]))
            feature = {"type": "Feature", "properties": {n: row[n] for n in names}, "geometry": shape}
            f.write((",\n" if k else "\n") + json.dumps(feature, ensure_ascii=False))
        f.write("\n]}\n")
    return path

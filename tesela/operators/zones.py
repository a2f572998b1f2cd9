"""Zone tables and the relations between administrative units and zones; lazy, and without I/O."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the key column in shape attributes, and the relation tables' names and ours.
KEY_NAMES = ("id", "id_1", "codigo", "codigoine", "cod_mun")
RELATION_COLUMNS_2 = {
    "seccion_ine": "census_sections", "distrito_ine": "census_districts", "municipio_ine": "municipalities",
    "municipio_mitma": "municipalities_mitma", "distrito_mitma": "districts_mitma", "gau_mitma": "luas_mitma",
}
RELATION_COLUMNS_1 = {
    "distrito": "census_districts", "distrito_mitma": "districts_mitma", "municipio": "municipalities",
    "municipio_mitma": "municipalities_mitma",
}


def na_to_null(df: DataFrame) -> DataFrame:
    """'NA' as null in every text column."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("NA")) for c, t in df.dtypes if t == "string"})


def with_key(shapes: DataFrame) -> DataFrame:
    """shapes with its key column as trimmed text named zone_id, in place of the source's column."""
    key = next((c for c in shapes.columns if c.lower() in KEY_NAMES), None)
    if key is None:
        raise KeyError(f"no zone key among {shapes.columns}")
    return shapes.withColumn("zone_id", F.trim(F.col(key).cast("string"))).drop(key)


def zone_table(names: DataFrame, population: DataFrame, shapes: DataFrame) -> DataFrame:
    """Zones of generation 2: id, name, population, and the shape's columns where there is one."""
    shapes = with_key(shapes)
    clash = {c.lower() for c in shapes.columns} & {"name", "population", "id"}
    if clash:
        raise ValueError(f"columns overlap: {sorted(clash)}")
    keyed = names.withColumnRenamed(names.columns[0], "zone_id")
    people = na_to_null(population).withColumnRenamed(population.columns[0], "zone_id")
    return keyed.join(people, "zone_id", "left").join(shapes, "zone_id", "left").withColumnRenamed("zone_id", "id")


def zone_table_v1(shapes: DataFrame) -> DataFrame:
    return with_key(shapes).withColumnRenamed("zone_id", "id")


def relations_v2(raw: DataFrame) -> DataFrame:
    return na_to_null(raw.withColumnsRenamed(RELATION_COLUMNS_2))


def relations_v1(municipalities: DataFrame, districts: DataFrame, zones: str, keep_nulls: bool = False) -> DataFrame:
    """For each zone id the sorted set of each other column's values.

    zones: 'municipios' joins districts to municipalities, 'distritos' the other way round. Nulls are left out of the
    sets unless keep_nulls, which appends one.
    """
    level = zones.removesuffix("s")
    key = f"{level}_mitma"
    if level == "municipio":
        left = municipalities.withColumnRenamed(key, "id")
        joined = left.join(districts, left.id.eqNullSafe(districts[key]), "left").drop(districts[key])
    else:
        left = districts.withColumnRenamed(key, "id")
        common = "municipio_mitma"
        right = municipalities.withColumnRenamed(common, "__common")
        joined = left.join(right, left[common].eqNullSafe(F.col("__common")), "left").drop("__common")
    joined = joined.withColumnsRenamed(RELATION_COLUMNS_1)

    def members(c: str):
        found = F.array_sort(F.collect_set(c))
        if keep_nulls:
            null = F.array(F.lit(None).cast("string"))
            found = F.when(F.bool_or(F.col(c).isNull()), F.concat(found, null)).otherwise(found)
        return found.alias(c)

    return joined.groupBy("id").agg(*(members(c) for c in joined.columns if c != "id"))

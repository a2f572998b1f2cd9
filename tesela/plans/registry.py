"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import normalize as N
from tesela.functions import vocab
from tesela.operators import flows, sinks, zones
from tesela.plans.adapter import OD_RAW, OVERNIGHT_RAW, TRIPS_MORE, TRIPS_RAW, as_file, as_parts, raw, work_folder
from tesela.sources import catalog, files, shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# SQL of the normal forms, for DuckDB; its regular expressions have no look-around.
def s_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_clean(x: str) -> str:
    t = s_trim(x)
    return f"(CASE WHEN {t} NOT IN ('', 'NA', 'nan', 'None') THEN {t} END)"


def s_zeros(x: str) -> str:
    return rf"regexp_replace({x}, '\.0+$', '')"


def s_zone(x: str) -> str:
    once = rf"regexp_replace({s_zeros(s_clean(x))}, '(\d)\.(\d)', '\1\2', 'g')"
    return rf"regexp_replace({once}, '(\d)\.(\d)', '\1\2', 'g')"


def s_date(x: str) -> str:
    d = f"lpad(regexp_replace({s_zeros(s_clean(x))}, '[-/ ]', '', 'g'), 8, '0')"
    return f"(substring({d}, 1, 4) || '-' || substring({d}, 5, 2) || '-' || substring({d}, 7, 2))"


NUM = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"


def s_point(x: str) -> str:
    return f"replace({s_clean(x)}, ',', '.')"


def s_number(text: str) -> str:
    return f"(CASE WHEN regexp_matches({text}, '{NUM}') THEN TRY_CAST({text} AS DOUBLE) END)"


def s_label(x: str, labels: dict[str, str]) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in labels.items()) + f" ELSE {x} END)"


OD_NORMAL = f"""
    SELECT source_file, {s_date("fecha")} AS date, CAST({s_number(s_point("periodo"))} AS INTEGER) AS hour,
           {s_zone("origen")} AS id_origin, {s_zone("destino")} AS id_destination,
           {s_label("actividad_origen", vocab.ACTIVITIES)} AS activity_origin,
           {s_label("actividad_destino", vocab.ACTIVITIES)} AS activity_destination,
           renta AS income, nullif(edad, 'NA') AS age,
           {s_label("nullif(sexo, 'NA')", vocab.GENDERS)} AS gender,
           {s_number(s_point("nullif(viajes, 'NA')"))} AS n_trips, {s_number(s_point("viajes_km"))} AS km
    FROM ({OD_RAW})
"""


def od_sql(*keys: str, per_file: bool = True) -> str:
    """Flows over all keys; two pseudo-files are summed apart."""
    named = ", ".join(("date", "hour", "id_origin", "id_destination", *keys))
    present = " AND ".join(f"{k} IS NOT NULL" for k in ("date", "hour", "id_origin", "id_destination", *keys))
    return f"""
        SELECT {named}, round(sum(n_trips), 2) AS n_trips, round(sum(km), 2) AS trips_total_length_km
        FROM ({OD_NORMAL}) WHERE n_trips IS NOT NULL AND km IS NOT NULL AND {present}
        GROUP BY {"source_file, " if per_file else ""}{named}
    """


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in ("n_trips", "trips_total_length_km")})


def od_query(name: str, keys: tuple[str, ...], **flags) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(flows.od(raw(spark, sf_dir, OD_RAW), **flags))

    query(name, od_sql(*keys))(run)


od_query("od_base", ())
od_query("od_activity", flows.ACTIVITY_KEYS, keep_activity=True)
od_query("od_social", flows.SOCIAL_KEYS, social_agg=True)
od_query("od_full", (*flows.ACTIVITY_KEYS, *flows.SOCIAL_KEYS), keep_activity=True, social_agg=True)
od_query("od_v1", (), keep_activity=True, social_agg=True, version=1)


@query("per_file_aggregate", od_sql("gender"))
def per_file_aggregate(spark, sf_dir):
    od = flows.od(raw(spark, sf_dir, OD_RAW).drop("renta", "edad"), social_agg=True, keep_null_groups=True)
    return rounded(od.drop("income", "age").where("gender IS NOT NULL AND hour IS NOT NULL"))


@query("od_one_file", od_sql(per_file=False))
def od_one_file(spark, sf_dir):
    return rounded(flows.od(raw(spark, sf_dir, OD_RAW).drop(flows.FILE)))


@query(
    "dropna_required",
    f"SELECT count(*) AS n_rows, count(gender) AS n_gender FROM ({OD_NORMAL}) WHERE date IS NOT NULL AND "
    "id_origin IS NOT NULL AND id_destination IS NOT NULL AND n_trips IS NOT NULL AND km IS NOT NULL",
)
def dropna_required(spark, sf_dir):
    rows = raw(spark, sf_dir, OD_RAW).withColumns({c: N.raw_null(F.col(c)) for c in ("viajes", "sexo")})
    rows = rows.select("fecha", "origen", "destino", "sexo", N.number(F.col("viajes")).alias("viajes"), "viajes_km")
    rows = rows.dropna(subset=["fecha", "origen", "destino", "viajes", "viajes_km"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("sexo").alias("n_gender"))


@query(
    "overnight",
    f"""
    SELECT {s_date("fecha")} AS date, {s_zone("zona_residencia")} AS residence_area,
           {s_zone("zona_pernoctacion")} AS overnight_stay_area, {s_number(s_point("personas"))} AS people, extra
    FROM ({OVERNIGHT_RAW}) WHERE personas <> 'NA'
    """,
)
def overnight(spark, sf_dir):
    return flows.overnight(raw(spark, sf_dir, OVERNIGHT_RAW))


def trips_sql(zone: str, more: str, last: str) -> str:
    return f"""
        SELECT {s_date("fecha")} AS date, {s_zone(zone)} AS overnight_stay_area,
               {s_zeros(s_trim("numero_viajes"))} AS number_of_trips, {s_number(s_point("personas"))} AS people, {last}
        FROM ({TRIPS_RAW.format(zone=zone, more=more)}) WHERE personas IS NOT NULL
    """


@query(
    "trips_v2",
    trips_sql("zona_pernoctacion", TRIPS_MORE, f"edad AS age, {s_label("nullif(sexo, 'NA')", vocab.GENDERS)} AS gender"),
)
def trips_v2(spark, sf_dir):
    return flows.trips(raw(spark, sf_dir, TRIPS_RAW.format(zone="zona_pernoctacion", more=TRIPS_MORE)))


@query("trips_v1", trips_sql("distrito", "", "CAST(NULL AS VARCHAR) AS age, CAST(NULL AS VARCHAR) AS gender"))
def trips_v1(spark, sf_dir):
    return flows.trips(raw(spark, sf_dir, TRIPS_RAW.format(zone="distrito", more="")), version=1)


@query(
    "union_by_name",
    f"""
    SELECT date, count(*) AS n_rows, count(gender) AS n_gender, round(sum(n_trips), 2) AS n_trips FROM (
        SELECT date, gender, n_trips FROM ({OD_NORMAL}) WHERE source_file = 'f0' AND n_trips IS NOT NULL
        UNION ALL SELECT date, NULL, n_trips FROM ({OD_NORMAL}) WHERE source_file = 'f1' AND n_trips IS NOT NULL
    ) GROUP BY date
    """,
)
def union_by_name(spark, sf_dir):
    rows = raw(spark, sf_dir, OD_RAW)
    parts = [rows.where("source_file = 'f0'"), rows.where("source_file = 'f1'").drop("sexo")]
    both = flows.union_files(parts).select(
        N.iso_date(F.col("fecha")).alias("date"),
        N.raw_null(F.col("sexo")).alias("gender"),
        N.number(F.col("viajes")).alias("n_trips"),
    )
    sums = both.dropna(subset=["n_trips"]).groupBy("date")
    return sums.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("gender").alias("n_gender"), F.round(F.sum("n_trips"), 2).alias("n_trips")
    )


# Scalar functions, over every part key rendered in awkward spellings.
SPELLINGS = """
    SELECT p_partkey, CASE p_partkey % 16
        WHEN 0 THEN concat(CAST(p_partkey AS VARCHAR(20)), '.0') WHEN 1 THEN concat('  ', CAST(p_partkey AS VARCHAR(20)), ' ')
        WHEN 2 THEN 'NA' WHEN 3 THEN '' WHEN 4 THEN concat('1.', lpad(CAST(p_partkey % 1000 AS VARCHAR(20)), 3, '0'))
        WHEN 5 THEN concat('2022-01-', lpad(CAST(p_partkey % 28 AS VARCHAR(9)), 2, '0'))
        WHEN 6 THEN concat('2022/1', CAST(p_partkey % 10 AS VARCHAR(9))) WHEN 7 THEN concat('01009_', p_brand)
        WHEN 8 THEN concat(CAST(p_size AS VARCHAR(9)), ',5') WHEN 9 THEN concat('-', CAST(p_size AS VARCHAR(9)), 'e2')
        WHEN 10 THEN concat('1.', lpad(CAST(p_partkey % 1000 AS VARCHAR(20)), 3, '0'), '.000') WHEN 11 THEN 'None'
        WHEN 12 THEN '2+' WHEN 13 THEN concat(CAST(p_size AS VARCHAR(9)), 'd') WHEN 14 THEN '2.00'
        ELSE concat('.', CAST(p_size AS VARCHAR(9))) END AS v
    FROM part
"""


def scalar(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw(spark, sf_dir, SPELLINGS).select("p_partkey", column(F.col("v")).alias("out"))

    query(name, f"SELECT p_partkey, {sql} AS out FROM ({SPELLINGS})")(run)


S_GROUPED = r"^[+-]?\d{1,3}(\.\d{3})+$"
S_DEGROUPED = f"(CASE WHEN regexp_matches({s_point('v')}, '{S_GROUPED}') THEN replace({s_point('v')}, '.', '') ELSE {s_point('v')} END)"
S_INTEGER = rf"(CASE WHEN regexp_matches({s_point('v')}, '^[+-]?\d+(\.0+)?$') THEN {s_point('v')} ELSE replace({s_point('v')}, '.', '') END)"
scalar("norm_zone_id", N.zone_id, s_zone("v"))
scalar("norm_date", N.iso_date, s_date("v"))
scalar("norm_number", N.number, s_number(s_point("v")))
scalar("norm_number_thousands", lambda c: N.number(c, F.lit(True)), s_number(S_DEGROUPED))
scalar("norm_grouped_int", N.grouped_integer, f"CAST({s_number(S_INTEGER)} AS BIGINT)")
scalar("norm_trip_label", N.trip_label, s_zeros(s_trim("v")))


@query(
    "relabel",
    f"""SELECT l_orderkey, l_linenumber, {s_label("a", vocab.ACTIVITIES)} AS activity, {s_label("g", vocab.GENDERS)} AS gender
    FROM (SELECT l_orderkey, l_linenumber,
        CASE l_linenumber WHEN 1 THEN 'casa' WHEN 2 THEN ' casa' WHEN 3 THEN 'no_frecuente' WHEN 4 THEN 'frecuente'
             WHEN 5 THEN 'trabajo_estudio' ELSE l_returnflag END AS a,
        CASE l_linenumber WHEN 1 THEN 'hombre' WHEN 2 THEN 'mujer' WHEN 3 THEN 'Hombre' END AS g FROM lineitem)""",
)
def relabel(spark, sf_dir):
    rows = raw(
        spark,
        sf_dir,
        """SELECT l_orderkey, l_linenumber,
        CASE l_linenumber WHEN 1 THEN 'casa' WHEN 2 THEN ' casa' WHEN 3 THEN 'no_frecuente' WHEN 4 THEN 'frecuente'
             WHEN 5 THEN 'trabajo_estudio' ELSE l_returnflag END AS a,
        CASE l_linenumber WHEN 1 THEN 'hombre' WHEN 2 THEN 'mujer' WHEN 3 THEN 'Hombre' END AS g FROM lineitem""",
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        N.relabel(F.col("a"), vocab.ACTIVITIES).alias("activity"),
        N.relabel(F.col("g"), vocab.GENDERS).alias("gender"),
    )


HOURS = """
    SELECT l_orderkey, l_linenumber, concat('f', CAST(l_suppkey % 2 AS VARCHAR(9))) AS source_file,
           CASE WHEN l_suppkey % 2 = 1 AND l_orderkey % 50 = 0 THEN 'night' ELSE concat('0', CAST(l_linenumber AS VARCHAR(9)), ' ') END AS hour
    FROM lineitem
"""


@query(
    "hour_typing",
    f"""WITH h AS ({HOURS}), f AS (
        SELECT source_file, bool_and(TRY_CAST(trim(hour) AS DOUBLE) IS NOT NULL) AS whole FROM h GROUP BY source_file)
    SELECT l_orderkey, l_linenumber, CASE WHEN whole THEN CAST(TRY_CAST(trim(hour) AS INTEGER) AS VARCHAR) ELSE trim(hour) END AS hour
    FROM h JOIN f USING (source_file)""",
)
def hour_typing(spark, sf_dir):
    rows = raw(spark, sf_dir, HOURS)
    rows = flows.with_file_facts(rows, {"whole": F.bool_and(N.number(F.col("hour")).isNotNull())})
    as_int = N.number(F.col("hour")).cast("int").cast("string")
    return rows.select(
        "l_orderkey", "l_linenumber", F.when(F.col("whole"), as_int).otherwise(N.trim_all(F.col("hour"))).alias("hour")
    )


@query(
    "thousands_by_file",
    f"""WITH t AS (SELECT p_partkey, p_size % 2 AS f, CASE WHEN p_size % 2 = 0 AND p_partkey % 7 = 0 THEN '1.234.567'
                 ELSE concat('12.', lpad(CAST(p_partkey % 1000 AS VARCHAR(9)), 3, '0')) END AS v FROM part),
        g AS (SELECT f, bool_or(v = '1.234.567') AS grouped FROM t GROUP BY f)
    SELECT p_partkey, CASE WHEN grouped THEN CAST(replace(v, '.', '') AS DOUBLE) ELSE CAST(v AS DOUBLE) END AS people
    FROM t JOIN g USING (f)""",
)
def thousands_by_file(spark, sf_dir):
    rows = raw(
        spark,
        sf_dir,
        """SELECT p_partkey, CAST(p_size % 2 AS VARCHAR(9)) AS source_file,
           CASE WHEN p_size % 2 = 0 AND p_partkey % 7 = 0 THEN '1.234.567'
                ELSE concat('12.', lpad(CAST(p_partkey % 1000 AS VARCHAR(9)), 3, '0')) END AS v FROM part""",
    )
    rows = flows.with_file_facts(rows, {"grouped": F.bool_or(N.has_thousands(F.col("v")))})
    return rows.select("p_partkey", N.number(F.col("v"), F.col("grouped")).alias("people"))


@query(
    "zone_table",
    """SELECT n.id, n.name, p.population, r.r_name FROM
        (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS id, n_name AS name FROM nation) n
        LEFT JOIN (SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS id, nullif(CASE WHEN s_nationkey % 3 = 0 THEN 'NA'
                   ELSE CAST(count(*) AS VARCHAR) END, 'NA') AS population FROM supplier GROUP BY s_nationkey) p ON n.id = p.id
        LEFT JOIN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS id, r_name FROM nation JOIN region
                   ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0) r ON n.id = r.id""",
)
def zone_table(spark, sf_dir):
    sql = lambda q: raw(spark, sf_dir, q)
    names = sql("SELECT lpad(CAST(n_nationkey AS STRING), 5, '0') AS ID, n_name AS name FROM nation")
    people = sql(
        "SELECT lpad(CAST(s_nationkey AS STRING), 5, '0') AS ID, CASE WHEN s_nationkey % 3 = 0 THEN 'NA' "
        "ELSE CAST(count(*) AS STRING) END AS population FROM supplier GROUP BY s_nationkey"
    )
    shapes = sql(
        "SELECT concat(lpad(CAST(n_nationkey AS STRING), 5, '0'), ' ') AS CODIGO, r_name FROM nation JOIN region "
        "ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0"
    )
    return zones.zone_table(names, people, shapes)


MUNICIPALITIES = "SELECT n_name AS municipio, r_name AS municipio_mitma FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"
DISTRICTS = """SELECT s_name AS distrito, n_name AS distrito_mitma, r_name AS municipio_mitma FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'"""


def relations_sql(left: str, right: str, key: str, on: str, columns: dict[str, str]) -> str:
    sets = ", ".join(f"coalesce(string_agg(DISTINCT {c}, ',' ORDER BY {c}), '') AS {n}" for c, n in columns.items())
    return f"SELECT l.{key} AS id, {sets} FROM ({left}) l LEFT JOIN ({right}) r ON l.{on} = r.{on} GROUP BY l.{key}"


def joined_sets(df: DataFrame) -> DataFrame:
    return df.select("id", *(F.array_join(c, ",").alias(c) for c in df.columns if c != "id"))


@query(
    "relations_v1_municipio",
    relations_sql(
        MUNICIPALITIES, DISTRICTS, "municipio_mitma", "municipio_mitma",
        {"l.municipio": "municipalities", "r.distrito": "census_districts", "r.distrito_mitma": "districts_mitma"},
    ),
)
def relations_v1_municipio(spark, sf_dir):
    return joined_sets(zones.relations_v1(raw(spark, sf_dir, MUNICIPALITIES), raw(spark, sf_dir, DISTRICTS), "municipios"))


@query(
    "relations_v1_distrito",
    relations_sql(
        DISTRICTS, MUNICIPALITIES, "distrito_mitma", "municipio_mitma",
        {"l.distrito": "census_districts", "l.municipio_mitma": "municipalities_mitma", "r.municipio": "municipalities"},
    ),
)
def relations_v1_distrito(spark, sf_dir):
    return joined_sets(zones.relations_v1(raw(spark, sf_dir, MUNICIPALITIES), raw(spark, sf_dir, DISTRICTS), "distritos"))


@query(
    "relations_v2",
    """SELECT s_name AS census_sections, nullif(CASE WHEN s_suppkey % 4 = 0 THEN 'NA' ELSE n_name END, 'NA') AS census_districts,
       r_name AS municipalities FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def relations_v2(spark, sf_dir):
    rows = """SELECT s_name AS seccion_ine, CASE WHEN s_suppkey % 4 = 0 THEN 'NA' ELSE n_name END AS distrito_ine,
        r_name AS municipio_ine FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
    return zones.relations_v2(raw(spark, sf_dir, rows))


ITEMS = """
    SELECT concat(name, '.csv.gz') AS title, concat('https://example.org/a/', name, '.csv.gz') AS link, 'now' AS pub_date FROM (
        SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'readme' WHEN o_orderkey % 13 = 0
            THEN concat(CAST(year(o_orderdate) AS VARCHAR(4)), lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), '_od')
            ELSE concat(CAST(year(o_orderdate) AS VARCHAR(4)), lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'),
                        lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0'), '_od') END AS name FROM orders)
"""
S_CATALOG = f"""
    SELECT link, pub_date, substring(title, strpos(title, '.') + 1) AS file_extension,
           substring(n, 1, 4) || '-' || substring(n, 5, 2) AS data_ym,
           CASE WHEN regexp_matches(substring(n, 7, 2), '^\\d+$')
                THEN substring(n, 1, 4) || '-' || substring(n, 5, 2) || '-' || substring(n, 7, 2) END AS data_ymd,
           CAST(NULL AS VARCHAR) AS local_path, false AS downloaded
    FROM (SELECT *, substring(link, 23) AS n FROM ({ITEMS})) WHERE regexp_matches(substring(n, 1, 6), '^\\d+$')
"""


@query("catalog_parse", S_CATALOG)
def catalog_parse(spark, sf_dir):
    return catalog.mobility_catalog(raw(spark, sf_dir, ITEMS))


@query("valid_dates", f"SELECT DISTINCT data_ymd FROM ({S_CATALOG}) WHERE data_ymd IS NOT NULL")
def valid_dates(spark, sf_dir):
    return catalog.valid_dates(catalog.mobility_catalog(raw(spark, sf_dir, ITEMS)))


FEED = """
    SELECT 't' AS title, concat('https://example.org/', CASE page_id % 5 WHEN 0 THEN 'zonificacion_municipios.shp'
        WHEN 1 THEN 'relaciones_distrito_mitma.csv' WHEN 2 THEN 'nombres_distritos.csv' WHEN 3 THEN 'xnombres_gaus.csv'
        ELSE 'poblacion_municipios.csv' END) AS link, CAST(page_id AS VARCHAR(20)) AS pub_date FROM pages
"""


@query(
    "zoning_filter",
    f"""SELECT link, pub_date, substring(link, 21) AS filename FROM ({FEED}) WHERE substring(link, 21) IN
    ('zonificacion_municipios.shp', 'relaciones_distrito_mitma.csv', 'poblacion_municipios.csv')""",
)
def zoning_filter(spark, sf_dir):
    return catalog.zoning_catalog(raw(spark, sf_dir, FEED), zone="muni")


SPAN = "SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders"
S_DAYS = f"SELECT strftime(d, '%Y-%m-%d') AS data_ymd FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM ({SPAN}))"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = raw(spark, sf_dir, SPAN).first()
    return catalog.dates_between(spark, str(span.a), str(span.b))


@query("date_range", S_DAYS)
def date_range(spark, sf_dir):
    return days(spark, sf_dir)


def plan_query(name: str, dataset: str, zone: str, version: int, url: str, own: str) -> None:
    sql = f"""SELECT data_ymd, '{url}'.replace('MONTH', substring(data_ymd, 1, 7)).replace('DAY', replace(data_ymd, '-', '')) AS url,
        replace(data_ymd, '-', '') || '{own}' AS file_name FROM ({S_DAYS})"""
    query(name, sql)(lambda spark, sf_dir: catalog.download_plan(days(spark, sf_dir), dataset, zone, version))


_V2, _V1 = catalog.FILE_ROOTS[2], catalog.FILE_ROOTS[1]
plan_query("url_plan_od_v2", "Viajes", "municipios", 2, f"{_V2}/por-municipios/viajes/ficheros-diarios/MONTH/DAY_Viajes_municipios.csv.gz", "_Viajes_municipios_v2.csv.gz")
plan_query("url_plan_trips_v2", "Personas", "GAU", 2, f"{_V2}/por-GAU/personas/ficheros-diarios/MONTH/DAY_Personas_dia_GAU.csv.gz", "_Personas_GAU_v2.csv.gz")
plan_query("url_plan_od_v1", "maestra1", "distritos", 1, f"{_V1}/maestra1-mitma-distritos/ficheros-diarios/MONTH/DAY_maestra_1_mitma_distrito.txt.gz", "_maestra1_distritos_v1.txt.gz")


# Queries that go through files: tables are written as the source's files and read back.
@query("od_auto_hours", od_sql())
def od_auto_hours(spark, sf_dir):
    return rounded(flows.od(raw(spark, sf_dir, OD_RAW), hour_mode="auto"))


@query("od_files", od_sql())
def od_files(spark, sf_dir):
    rows, folder = raw(spark, sf_dir, OD_RAW), work_folder(spark)
    paths = [
        as_parts(rows.where(f"source_file = '{f}'").drop(flows.FILE), folder, f, sep="|", compression="gzip") for f in ("f0", "f1")
    ]
    facts = lambda frame: flows.file_facts(frame, "od")
    found = files.scan(spark, paths, flows.required_columns("od", 2), facts=facts)
    return rounded(flows.od(found.frame, hour_mode="auto", facts=found.facts))


@query(
    "overnight_files",
    f"""
    SELECT {s_date("fecha")} AS date, {s_zone("zona_residencia")} AS residence_area,
           {s_zone("zona_pernoctacion")} AS overnight_stay_area, {s_number(s_point("personas"))} AS people, extra
    FROM ({OVERNIGHT_RAW}) WHERE personas <> 'NA'
    """,
)
def overnight_files(spark, sf_dir):
    """Two files of one base name, with columns in another order and names in capitals."""
    rows, folder = raw(spark, sf_dir, OVERNIGHT_RAW), work_folder(spark)
    halves = rows.where("extra < 'Customer#0000005'"), rows.where("extra >= 'Customer#0000005'")
    other = halves[1].select(*(F.col(c).alias(f" {c.upper()} ") for c in reversed(rows.columns)))
    paths = [as_parts(half, folder, name, sep="|") for half, name in ((halves[0], "a"), (other, "b"))]
    found = files.scan(spark, paths, flows.required_columns("overnight", 2))
    return flows.overnight(found.frame)


S_NATIONS = "SELECT lpad(CAST(n_nationkey AS VARCHAR(9)), 5, '0') AS id, n_name AS name FROM nation"


@query("zone_csv", f"SELECT id, name, 'with' AS kind FROM ({S_NATIONS}) UNION ALL SELECT id, name, 'without' FROM ({S_NATIONS})")
def zone_csv(spark, sf_dir):
    """Zone tables with and without a header."""
    rows, folder = raw(spark, sf_dir, S_NATIONS), work_folder(spark)
    padded = rows.select(F.concat(F.lit(" "), "id", F.lit(" ")).alias("ID"), "name")
    read = []
    for kind, header in (("with", "true"), ("without", "false")):
        path = as_file(padded, folder, kind, sep="|", header=header)
        read.append(files.read_zone_column(spark, path, ("ID", "name")).select(F.col("ID").alias("id"), "name", F.lit(kind).alias("kind")))
    return read[0].unionByName(read[1])


@query("relation_files", " UNION ALL ".join(f"SELECT id, name, {k} AS kind FROM ({S_NATIONS})" for k in range(4)))
def relation_files(spark, sf_dir):
    """One table with each of the four delimiters."""
    rows, folder, read = raw(spark, sf_dir, S_NATIONS), work_folder(spark), []
    for k, sep in enumerate("|,;\t"):
        read.append(files.read_relations(spark, as_file(rows, folder, str(k), sep=sep)).withColumn("kind", F.lit(k)))
    return flows.union_files(read)


@query("geojson_round_trip", f"SELECT id, name, CAST(length(name) AS VARCHAR) AS size FROM ({S_NATIONS})")
def geojson_round_trip(spark, sf_dir):
    rows = raw(spark, sf_dir, S_NATIONS).withColumn("size", F.length("name").cast("string"))
    path = f"{work_folder(spark)}/zones.geojson"
    sinks.save_geojson(rows.withColumn("geometry_wkb", F.lit(None).cast("binary")), path)
    return shapes.read_geojson(spark, path).select("id", "name", "size")


@query("parquet_sink", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def parquet_sink(spark, sf_dir):
    """A saved table read back."""
    rows = raw(spark, sf_dir, "SELECT l_returnflag, l_linestatus FROM lineitem")
    path = sinks.save_table(rows, f"{work_folder(spark)}/{sinks.table_name('Viajes', 'GAU', 'a', 'b', 2)}")
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))

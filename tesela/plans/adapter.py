"""Raw mobility frames made from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Bytes of tables, as they are stored, whose rows make one partition where there are more than cores ask for.
PARTITION_BYTES = 16 << 20
#: Rows of a part of a file, which one task writes and reads whole.
PART_ROWS = 500_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

#: Year starts with some '.0' and some dashes, hours '00' to '02', zones with and without '.0', decimal commas.
OD_RAW = """
    SELECT CASE WHEN l_linenumber % 3 = 0 THEN concat(CAST(year(l_shipdate) AS VARCHAR(4)), '-01-01')
                WHEN l_linenumber % 3 = 1 THEN concat(CAST(year(l_shipdate) AS VARCHAR(4)), '0101.0')
                ELSE concat(' ', CAST(year(l_shipdate) AS VARCHAR(4)), '0101') END AS fecha,
           lpad(CAST(l_linenumber % 3 AS VARCHAR(9)), 2, '0') AS periodo,
           concat(lpad(CAST(s_nationkey AS VARCHAR(9)), 5, '0'), '.0') AS origen,
           lpad(CAST(c_nationkey AS VARCHAR(9)), 5, '0') AS destino,
           CASE l_returnflag WHEN 'A' THEN 'casa' WHEN 'N' THEN 'frecuente' ELSE 'trabajo_estudio' END AS actividad_origen,
           CASE l_linestatus WHEN 'O' THEN 'casa' ELSE 'no_frecuente' END AS actividad_destino,
           CASE c_mktsegment WHEN 'BUILDING' THEN '<10' WHEN 'MACHINERY' THEN '10-15' ELSE '>15' END AS renta,
           CASE o_orderpriority WHEN '1-URGENT' THEN '0-25' WHEN '2-HIGH' THEN '25-45' WHEN '3-MEDIUM' THEN '45-65'
                WHEN '4-NOT SPECIFIED' THEN '65-100' ELSE 'NA' END AS edad,
           CASE o_orderstatus WHEN 'F' THEN 'hombre' WHEN 'O' THEN 'mujer' ELSE 'NA' END AS sexo,
           CASE WHEN l_linenumber = 2 THEN replace(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR(30)), '.', ',')
                WHEN l_linenumber = 7 THEN 'NA'
                ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR(30)) END AS viajes,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)) AS viajes_km,
           concat('f', CAST(l_linenumber % 2 AS VARCHAR(9))) AS source_file
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
"""
OVERNIGHT_RAW = """
    SELECT '20220101' AS fecha, concat(lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0'), '.0') AS zona_residencia,
           lpad(CAST(c_nationkey AS VARCHAR(9)), 5, '0') AS zona_pernoctacion,
           CASE WHEN c_custkey % 10 = 0 THEN 'NA' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR(30)) END AS personas,
           c_name AS extra
    FROM customer
"""
TRIPS_RAW = """
    SELECT concat(CAST(year(ts) AS VARCHAR(4)), '/', lpad(CAST(month(ts) AS VARCHAR(2)), 2, '0'), '/',
                  lpad(CAST(day(ts) AS VARCHAR(2)), 2, '0')) AS fecha,
           concat(CAST(user_id AS VARCHAR(20)), '.0') AS {zone},
           concat(CAST(event_id % 3 AS VARCHAR(9)), CASE WHEN event_id % 3 = 2 THEN '+' ELSE '.0' END) AS numero_viajes,
           CAST(CAST(value AS DECIMAL(18,3)) AS VARCHAR(30)) AS personas{more}
    FROM events
"""
TRIPS_MORE = ", event_type AS edad, CASE WHEN event_id % 2 = 0 THEN 'hombre' WHEN event_id % 5 = 0 THEN 'NA' ELSE 'Mujer' END AS sexo"


def raw(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables of sf_dir; views have names of their own, so the session's are left alone.

    Small tables come in few partitions, as many files don't; the rows are dealt out to all cores, and those of larger
    tables to as many partitions as keep one small. Without the exchange the expressions here and those of the operators
    would be one method, which with all keys is too long for the JVM to compile.
    """
    import re

    size = 0
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            table.createOrReplaceTempView(f"__tesela_{name}")
            size += int(str(table._jdf.queryExecution().analyzed().stats().sizeInBytes()))
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 __tesela_{name}", sql)
    return spark.sql(sql).repartition(max(spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES)))


def work_folder(spark: SparkSession) -> str:
    """A new local folder below spark.checkpoint.dir, or on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        path = os.path.join(urlparse(base).path, "tesela-files", uuid.uuid4().hex)
        os.makedirs(path)
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tesela-files-")


def as_file(df: DataFrame, folder: str, name: str, **options: str) -> str:
    """df, which is small, as one delimited file in folder, written by one task; its path."""
    target = os.path.join(folder, name)
    df.coalesce(1).write.options(**({"header": "true", "escape": '"'} | options)).csv(f"file://{target}")
    return next(os.path.join(target, n) for n in sorted(os.listdir(target)) if n.startswith("part-"))


def as_parts(df: DataFrame, folder: str, name: str, **options: str) -> str:
    """df as one delimited file in parts, each with the header and written by one task; the path of the parts' folder."""
    target = os.path.join(folder, name)
    df.write.options(**({"header": "true", "escape": '"', "maxRecordsPerFile": PART_ROWS} | options)).csv(f"file://{target}")
    return target

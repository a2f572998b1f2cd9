"""The three standard tables, from raw frames of text columns to typed frames.

A raw frame has normalised header names and a column source_file. Semantics that depend on a whole file (thousands,
the kind of hour) are facts of files: one small aggregate with a row a file, which comes to the driver like the listing
of the files does, and goes back as a local table whose size Spark knows. Where no facts are handed in, the functions
here collect those that they need; all else is lazy.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions import normalize as N
from tesela.functions.vocab import ACTIVITIES, GENDERS, RAW_NULLS

FILE = "source_file"

# The source's column names and ours.
OD_COLUMNS = {
    "fecha": "date", "periodo": "hour", "origen": "id_origin", "destino": "id_destination",
    "actividad_origen": "activity_origin", "actividad_destino": "activity_destination",
    "residencia": "residence_province_ine_code", "distancia": "distance", "viajes": "n_trips",
    "viajes_km": "trips_total_length_km", "renta": "income", "edad": "age", "sexo": "gender",
}
OVERNIGHT_COLUMNS = {
    "fecha": "date", "zona_residencia": "residence_area", "zona_pernoctacion": "overnight_stay_area", "personas": "people",
}
TRIPS_COLUMNS = {
    1: {"fecha": "date", "distrito": "overnight_stay_area", "numero_viajes": "number_of_trips", "personas": "people"},
    2: {
        "fecha": "date", "zona_pernoctacion": "overnight_stay_area", "edad": "age", "sexo": "gender",
        "numero_viajes": "number_of_trips", "personas": "people",
    },
}
OD_REQUIRED = ("date", "hour", "id_origin", "id_destination", "n_trips", "trips_total_length_km")
OD_VALID = ("date", "id_origin", "id_destination", "n_trips", "trips_total_length_km")
OD_KEYS = ("date", "hour", "id_origin", "id_destination")
ACTIVITY_KEYS = ("activity_origin", "activity_destination")
SOCIAL_KEYS = ("income", "age", "gender")
OVERNIGHT_REQUIRED = ("date", "residence_area", "overnight_stay_area", "people")
TRIPS_REQUIRED = ("date", "overnight_stay_area", "number_of_trips", "people")


def required_columns(kind: str, version: int) -> tuple[str, ...]:
    """Raw names that a file of a dataset must have."""
    names, needed = {
        "od": (OD_COLUMNS, OD_REQUIRED),
        "overnight": (OVERNIGHT_COLUMNS, OVERNIGHT_REQUIRED),
        "trips": (TRIPS_COLUMNS[version], TRIPS_REQUIRED),
    }[kind]
    return tuple(raw for raw, ours in names.items() if ours in needed)


def _prepared(raw: DataFrame, names: dict[str, str], optional: tuple[str, ...]) -> DataFrame:
    """Our names, optional columns added as null, all as text."""
    df = raw.withColumnsRenamed(names)
    missing = [c for c in optional if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("string") for c in missing})
    if FILE not in df.columns:
        df = df.withColumn(FILE, F.lit(""))
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in df.columns if c != FILE})


def file_facts(raw: DataFrame, kind: str, version: int = 2) -> dict[str, Column]:
    """Aggregates over a file of raw rows: its kinds of numbers and hours, and its number of valid rows."""
    names = {"od": OD_COLUMNS, "overnight": OVERNIGHT_COLUMNS, "trips": TRIPS_COLUMNS[version]}[kind]
    of = {ours: F.col(f"`{raw_name}`") for raw_name, ours in names.items() if raw_name in raw.columns}
    measures = [m for m in ("n_trips", "trips_total_length_km", "people") if m in of]
    facts = {f"grouped_{m}": F.bool_or(N.has_thousands(of[m])) for m in measures}
    if "hour" in of:
        facts["whole_hours"] = F.bool_and(N.is_number(of["hour"]))
    valid = F.lit(True)
    for c in {"od": OD_VALID, "overnight": OVERNIGHT_REQUIRED, "trips": TRIPS_REQUIRED}[kind]:
        if c in measures:
            valid &= N.is_number(of[c]) | N.has_thousands(of[c])
        elif c in of:
            valid &= N.is_known(of[c])
    return facts | {"valid": F.count_if(valid)}


def collect_facts(df: DataFrame, facts: dict[str, Column]) -> pa.Table:
    """One row a file."""
    return df.groupBy(FILE).agg(*(fact.alias(name) for name, fact in facts.items())).toArrow()


def with_file_facts(df: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """df with facts of each file; Spark broadcasts them if they are as small as it asks."""
    return df.join(df.sparkSession.createDataFrame(collect_facts(df, facts)), FILE)


def _with_grouped(df: DataFrame, facts: pa.Table, measures: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """df, and which measures may have grouped thousands: as columns that say so of the row's file."""
    some = [m for m in measures if any(facts.column(f"grouped_{m}").to_pylist())]
    if not some:
        return df, {}
    flags = [f"grouped_{m}" for m in some]
    known = facts.select([FILE, *flags])
    if known.num_rows == 1:
        return df, {m: F.lit(True) for m in some}
    joined = df.join(df.sparkSession.createDataFrame(known), FILE, "left")
    return joined, {m: F.coalesce(f, F.lit(False)) for m, f in zip(some, flags)}


def _drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """df.dropna(subset), with the expressions that gave the columns worked out once a row.

    Filters are pushed below projections, which would repeat the expressions, but not below a numbering of rows.
    """
    number = "__row_number"
    whole = F.col(number) >= 0
    for c in subset:
        whole &= F.col(f"`{c}`").isNotNull()
    return df.withColumn(number, F.monotonically_increasing_id()).where(whole).drop(number)


def _in_steps(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """df with the columns of each step in turn."""
    for step in steps:
        df = df.withColumns(step)
    return df


def _number_steps(measures, grouped: dict[str, Column]) -> list[dict[str, Column]]:
    """Steps from cleaned text to numbers."""
    return [
        {m: F.translate(m, ",", ".") for m in measures},
        {m: N.ungrouped_step(F.col(m), grouped[m]) for m in measures if m in grouped},
        {m: N.number_step(F.col(m)) for m in measures},
    ]


def _text_steps(fields, dates, zones) -> list[dict[str, Column]]:
    """Steps from raw text to cleaned text, dates and zone identifiers."""
    return [
        {c: N.known(F.col(c), RAW_NULLS) for c in fields},
        {c: N.trim_all(F.col(c)) for c in fields},
        {c: N.known(F.col(c)) for c in fields},
        {c: N.zeros_step(F.col(c)) for c in dates} | {z: N.zone_step(F.col(z)) for z in zones},
        {c: N.digits_step(F.col(c)) for c in dates},
        {c: N.dashes_step(F.col(c)) for c in dates},
    ]


def od(
    raw: DataFrame,
    keep_activity: bool = False,
    social_agg: bool = False,
    version: int = 2,
    hour_mode: str = "int",
    thousands: bool = True,
    keep_null_groups: bool = False,
    facts: pa.Table | None = None,
    sort: bool = False,
) -> DataFrame:
    """Origin-destination flows, summed in each file over the chosen keys.

    Generation 1 has no activity or social columns and ignores both flags. A row with a null key is left out unless
    keep_null_groups. hour_mode: 'int' gives integers (null where a field isn't one), 'text' the trimmed text, 'auto'
    integers if every hour of every file is a number, else text. thousands: look for grouped thousands in each file.
    facts: those of file_facts, if they are known. sort: order the groups of all files by their keys.
    """
    if version == 1:
        keep_activity = social_agg = False
    measures = ("n_trips", "trips_total_length_km")
    labels = [*(ACTIVITY_KEYS if keep_activity else ()), *(SOCIAL_KEYS if social_agg else ())]
    if facts is None and (thousands or hour_mode == "auto"):
        found = raw if FILE in raw.columns else raw.withColumn(FILE, F.lit(""))
        wanted = ("grouped_" if thousands else "", "whole_hours" if hour_mode == "auto" else "")
        facts = collect_facts(found, {k: v for k, v in file_facts(raw, "od").items() if k.startswith(tuple(filter(None, wanted)))})
    df = _prepared(raw, OD_COLUMNS, (*ACTIVITY_KEYS, *SOCIAL_KEYS))
    if hour_mode == "auto":
        hour_mode = "int" if all(v in (True, None) for v in facts.column("whole_hours").to_pylist()) else "text"
    df, grouped = _with_grouped(df, facts, measures) if thousands else (df, {})
    fields = ["date", "id_origin", "id_destination", *measures]
    hours = ["hour"] if hour_mode == "int" else []
    df = df.select(FILE, *fields, "hour", *labels, *(c for c in df.columns if c.startswith("grouped_")))
    df = _in_steps(
        df,
        {c: N.known(F.col(c), RAW_NULLS) for c in ([] if hours else ["hour"]) + labels},
        {} if hours else {"hour": N.trim_all(F.col("hour"))},
        *_text_steps([*fields, *hours], ["date"], ["id_origin", "id_destination"]),
        *_number_steps([*measures, *hours], grouped),
        {c: F.col(c).try_cast("int") for c in hours},
        {c: N.relabel(F.col(c), ACTIVITIES) for c in ACTIVITY_KEYS if keep_activity},
        {"gender": N.relabel(F.col("gender"), GENDERS)} if social_agg else {},
    )
    keys = [*OD_KEYS, *labels]
    df = _drop_null_rows(df, list(OD_VALID) if keep_null_groups else [*OD_VALID, *(k for k in keys if k not in OD_VALID)])
    sums = df.groupBy(FILE, *keys).agg(*(F.sum(m).alias(m) for m in measures))
    return (sums.orderBy(FILE, *keys) if sort else sums).drop(FILE)


def overnight(raw: DataFrame, version: int = 2, thousands: bool = True, facts: pa.Table | None = None) -> DataFrame:
    """Overnight stays, a row for each valid raw row; other columns pass through."""
    if version == 1:
        raise Exception("overnight stays are not part of generation 1")
    zones = ("residence_area", "overnight_stay_area")
    return _rows(raw, "overnight", version, OVERNIGHT_COLUMNS, (), zones, thousands, OVERNIGHT_REQUIRED, facts)


def trips(raw: DataFrame, version: int = 2, thousands: bool = True, facts: pa.Table | None = None) -> DataFrame:
    """Numbers of trips a person, a row for each valid raw row; other columns pass through."""
    names, zones = TRIPS_COLUMNS[version], ("overnight_stay_area",)
    return _rows(raw, "trips", version, names, ("age", "gender"), zones, thousands, TRIPS_REQUIRED, facts)


def _rows(raw, kind, version, names, optional, zones, thousands, required, facts) -> DataFrame:
    if facts is None and thousands:
        found = raw if FILE in raw.columns else raw.withColumn(FILE, F.lit(""))
        facts = collect_facts(found, {k: v for k, v in file_facts(raw, kind, version).items() if k != "valid"})
    df = _prepared(raw, names, optional)
    columns = [c for c in df.columns if c != FILE]
    df, grouped = _with_grouped(df, facts, ("people",)) if thousands else (df, {})
    fields = ["date", "people", *zones]
    df = _in_steps(
        df,
        {c: N.known(F.col(f"`{c}`"), RAW_NULLS) for c in columns if c not in fields},
        {"number_of_trips": N.trim_all(F.col("number_of_trips"))} if "number_of_trips" in columns else {},
        {"number_of_trips": N.zeros_step(F.col("number_of_trips"))} if "number_of_trips" in columns else {},
        {"gender": N.relabel(F.col("gender"), GENDERS)} if "number_of_trips" in columns else {},
        *_text_steps(fields, ["date"], zones),
        *_number_steps(["people"], grouped),
    )
    return _drop_null_rows(df, list(required)).select(*(f"`{c}`" for c in columns))


def union_files(frames: list[DataFrame]) -> DataFrame | None:
    """All rows of the frames by column name, absent columns as null; None for no frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

"""Pipe-separated files as raw frames of text: headers are matched by name, file by file.

A file may come in parts, as a folder of files with the same header; its path is the folder's. The parts are read by as
many tasks as their size asks for, while a gzip file in one piece is one task.
"""

from __future__ import annotations

import csv
import gzip
import io
import os
import zipfile
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.functions.normalize import column_name
from tesela.operators.flows import FILE, collect_facts, union_files

_CORRUPT = "__corrupt"


class Scan(NamedTuple):
    frame: DataFrame | None
    accepted: list[str]
    rejected: list[tuple[str, str]]
    facts: pa.Table | None = None


def header_of(path: str, sep: str = "|") -> list[str]:
    """Normalised names of a local file's header; only its first line is read."""
    opened = gzip.open if path.endswith(".gz") else open
    with opened(path, "rb") as f:
        line = f.readline().decode("utf-8-sig")
    return [column_name(c) for c in next(csv.reader(io.StringIO(line), delimiter=sep), [])]


def parts_of(path: str) -> list[str]:
    """The files that a file is made of: those of a folder, without Spark's own, or the file itself."""
    if not os.path.isdir(path):
        return [path]
    return [os.path.join(path, n) for n in sorted(os.listdir(path)) if not n.startswith(("_", "."))]


def scan(
    spark: SparkSession,
    paths: list[str],
    required: tuple[str, ...] = (),
    strict_rows: bool = True,
    facts: Callable[[DataFrame], dict[str, Column]] | None = None,
) -> Scan:
    """One raw frame over many files, with source_file (the whole path); files of one header are one scan.

    Files that are absent, empty, unreadable or lack a required column are rejected with a reason, as are files in parts
    of which one is so or has another header than the rest, and so, with
    strict_rows, are files without a row, or with one that is longer than the header. One pass over the files finds
    those, and with it the facts of each accepted file, if aggregates for a raw frame are given; a file whose fact
    'valid' is 0 is rejected too.
    """
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    rejected: list[tuple[str, str]] = []
    for path in paths:
        try:
            parts = parts_of(path)
            if not parts or not all(os.path.exists(p) and os.path.getsize(p) for p in parts):
                raise ValueError("missing or empty file")
            names = header_of(parts[0])
            absent = [c for c in required if c not in names]
            if not names:
                raise ValueError("no header")
            if absent:
                raise ValueError(f"missing columns: {', '.join(absent)}")
            if any(header_of(p) != names for p in parts[1:]):
                raise ValueError("parts of several headers")
            groups[tuple(names), os.path.isdir(path)].append(path)
        except (OSError, EOFError, UnicodeDecodeError, ValueError) as e:
            rejected.append((path, str(e)))
    frames, accepted, found = [], [], []
    for (names, in_parts), files in groups.items():
        raw = _read(spark, files, names, in_parts)
        if strict_rows or facts:
            told = collect_facts(raw, {_CORRUPT: F.bool_or(_CORRUPT)} | (facts(raw.drop(_CORRUPT)) if facts else {}))
            of = {_local_path(r[FILE]): r for r in told.to_pylist()}
            reasons = {f: _fault(of.get(os.path.abspath(f)), strict_rows) for f in files}
            rejected += [(f, reason) for f, reason in reasons.items() if reason]
            good = [f for f in files if not reasons[f]]
            if not good:
                continue
            raw = _read(spark, good, names, in_parts) if len(good) < len(files) else raw
            files = good
            kept = {os.path.abspath(f) for f in files}
            found.append(told.filter(pa.array([_local_path(f) in kept for f in told.column(FILE).to_pylist()], pa.bool_())))
        accepted += files
        frames.append(raw.drop(_CORRUPT))
    table = pa.concat_tables(found, promote_options="default").drop_columns([_CORRUPT]) if facts and found else None
    return Scan(union_files(frames), accepted, rejected, table)


def _fault(told: dict | None, strict_rows: bool) -> str | None:
    """Why a file with these facts is rejected."""
    if told is None:
        return "no data rows"
    if strict_rows and told[_CORRUPT]:
        return "row longer than the header"
    return "no valid rows" if told.get("valid") == 0 else None


def _local_path(uri: str) -> str:
    return unquote(urlparse(uri).path)


def _read(spark: SparkSession, files: list[str], names: tuple[str, ...], in_parts: bool) -> DataFrame:
    """Text columns by position; a spare last column shows rows that are too long. in_parts: files are folders of parts."""
    unique = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*unique, "spare"]])
    reader = spark.read.schema(schema).options(sep="|", header="true", escape='"', enforceSchema="true", mode="PERMISSIVE")
    path = F.col("_metadata.file_path")
    raw = reader.csv(files).select("*", (F.regexp_replace(path, "/[^/]*$", "") if in_parts else path).alias(FILE))
    return raw.withColumn(_CORRUPT, F.col("spare").isNotNull()).select(
        *(F.col(c).alias(n) for c, n in zip(unique, names)), FILE, _CORRUPT
    )


def sniff_delimiter(path: str) -> str:
    """The first of | , ; TAB that parts the header into several columns, else the comma."""
    with open(path, encoding="utf-8-sig") as f:
        line = f.readline()
    return next((d for d in "|,;\t" if len(next(csv.reader([line], delimiter=d), [])) > 1), ",")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """A relation table of text columns, with any of four delimiters."""
    return spark.read.options(header="true", sep=sniff_delimiter(path), inferSchema="false", escape='"').csv(path)


def read_zone_column(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A pipe-separated zone table with or without a header; its first column is trimmed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).options(sep="|", header="false", escape='"').csv(path)
    first = F.trim(F.regexp_replace(F.col(columns[0]), "^﻿", ""))
    return raw.withColumn(columns[0], first).where(F.lower(columns[0]) != columns[0].lower())


def unzip(path: str, target: str) -> None:
    with zipfile.ZipFile(path) as bundle:
        bundle.extractall(target)


def resolve_file(name: str, own_dir: str, shared_dir: str) -> str:
    """name in own_dir, else in shared_dir, else the path it would have in own_dir."""
    own, shared = os.path.join(own_dir, name), os.path.join(shared_dir, name)
    return shared if not os.path.exists(own) and os.path.exists(shared) else own

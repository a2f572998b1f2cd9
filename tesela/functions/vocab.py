"""Names of zones, datasets and files, and the checks of user input."""

from __future__ import annotations

import re

# Spellings that users may give for each level of zones.
ZONE_ALIASES = {
    "distritos": ("districts", "dist", "distr", "distritos"),
    "municipios": ("municipalities", "muni", "municip", "municipal", "municipios"),
    "gaus": ("lua", "large_urban_areas", "gau", "gaus", "grandes_areas_urbanas"),
}
# Spellings of the three datasets, and each generation's name for them.
DATASET_ALIASES = {
    "od": ("od", "origin-destination"),
    "overnight": ("os", "overnight_stays"),
    "trips": ("nt", "number_of_trips"),
}
DATASET_NAMES = {
    1: {"od": "maestra1", "trips": "maestra2"},
    2: {"od": "Viajes", "overnight": "Pernoctaciones", "trips": "Personas"},
}
# Labels of the source and ours.
ACTIVITIES = {
    "casa": "home",
    "frecuente": "other_frequent",
    "trabajo_estudio": "work_or_study",
    "no_frecuente": "other_non_frequent",
}
GENDERS = {"hombre": "male", "mujer": "female"}
# Raw fields that mean "no value", and those that mean it after trimming.
RAW_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRIMMED_NULLS = ("", "NA", "nan", "None")

_CANONICAL = {alias: zone for zone, aliases in ZONE_ALIASES.items() for alias in aliases}
_DATASETS = {alias: kind for kind, aliases in DATASET_ALIASES.items() for alias in aliases}


def check_version(version: int) -> int:
    if version not in (1, 2):
        raise ValueError(f"version must be 1 or 2, not {version!r}")
    return version


def check_zone(zone: str, version: int) -> str:
    """The zone's alias in lower case; urban areas exist from generation 2 on."""
    name = str(zone).lower()
    if name not in _CANONICAL:
        raise ValueError(f"unknown zone {zone!r}; known are {', '.join(sorted(_CANONICAL))}")
    if version == 1 and _CANONICAL[name] == "gaus":
        raise Exception("large urban areas are not part of generation 1")
    return name


def check_dataset(kind: str) -> str:
    if str(kind).lower() not in _DATASETS:
        raise ValueError(f"unknown dataset {kind!r}; known are {', '.join(sorted(_DATASETS))}")
    return kind


def check_date(date: str) -> str:
    if not isinstance(date, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError(f"dates are written YYYY-MM-DD, not {date!r}")
    return date


def zone_name(zone: str) -> str:
    """The canonical zone level; other words pass through in lower case."""
    return _CANONICAL.get(zone.lower(), zone.lower())


def dataset_name(kind: str, version: int) -> str | None:
    """The generation's name of a dataset; None for unknown words."""
    known = _DATASETS.get(kind.lower())
    if known == "overnight" and version == 1:
        raise Exception("overnight stays are not part of generation 1")
    return DATASET_NAMES[version].get(known)

"""Mobility and Zones: the engine's two user-facing classes."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesela.functions import vocab
from tesela.operators import flows, sinks
from tesela.operators import zones as zone_ops
from tesela.sources import catalog, files, shapes

_settings = {"data_dir": os.path.join(os.path.expanduser("~"), "data")}


def get_data_directory() -> str:
    return _settings["data_dir"]


def set_data_directory(path: str) -> None:
    _settings["data_dir"] = path


def output_directory(path: str | None) -> str:
    """Absolute paths are kept, others lie under the home folder; None is the data directory. The folder is made."""
    if path is None:
        target = get_data_directory()
    elif os.path.isabs(path):
        target = path
    else:
        target = os.path.join(os.path.expanduser("~"), path.lstrip("/"))
    try:
        os.makedirs(target, exist_ok=True)
    except PermissionError as e:
        raise PermissionError(f"can't create {target}; give an output_directory that you may write to") from e
    return target


class Mobility:
    """The three daily tables of a version, zone level and range of dates.

    backend and use_dask are accepted for compatibility; Spark runs everything in parallel either way. fetch returns
    the bytes at a URL; feed the XML of a version's catalog.
    """

    def __init__(
        self,
        version: int = 2,
        zones: str = "municipalities",
        start_date: str | None = None,
        end_date: str | None = None,
        output_directory: str | None = None,
        use_dask: bool = False,
        backend: str = "arrow",
        spark: SparkSession | None = None,
        fetch: Callable[[str], bytes] = catalog.fetch_url,
        feed: Callable[[int], bytes] | None = None,
    ):
        if backend not in ("arrow", "pandas"):
            raise ValueError("backend is 'arrow' or 'pandas'")
        vocab.check_zone(zones, version)
        vocab.check_version(version)
        if start_date is None:
            raise ValueError("start_date is required")
        vocab.check_date(start_date)
        end_date = start_date if end_date is None else end_date
        vocab.check_date(end_date)
        if end_date < start_date:
            raise ValueError("end_date lies before start_date")
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.version, self.start_date, self.end_date = version, start_date, end_date
        self.backend, self.use_dask, self._fetch = backend, use_dask, fetch
        self.zones = vocab.zone_name(zones)
        try:
            xml = feed(version) if feed else fetch(catalog.FEEDS[version])
            items = catalog.feed_items(self.spark, xml)
            known = [r[0] for r in catalog.valid_dates(catalog.mobility_catalog(items, version)).collect()]
        except Exception as e:
            raise RuntimeError(f"the catalog of generation {version} can't be read: {e}") from e
        if not known:
            raise RuntimeError("the catalog lists no dates")
        if start_date < known[0] or end_date > known[-1]:
            raise ValueError(f"dates are available from {known[0]} to {known[-1]}")
        days = catalog.dates_between(self.spark, start_date, end_date).orderBy("data_ymd")
        self.dates = [r[0] for r in days.collect()]
        #: Days in the range that the catalog doesn't list, and files that were left out, with the reason.
        self.missing_dates = sorted(set(self.dates) - set(known))
        self.rejected: list[tuple[str, str]] = []
        self.output_path = _output(output_directory)
        if version == 2 and self.zones == "gaus":
            self.zones = "GAU"

    def _files(self, dataset: str) -> list[str]:
        """Local files of the dataset's days; a failed download warns and is left out."""
        days = self.spark.createDataFrame([(d,) for d in self.dates], "data_ymd string")
        found = []
        for row in catalog.download_plan(days, dataset, self.zones, self.version).orderBy("data_ymd").collect():
            path = os.path.join(self.output_path, row.file_name)
            try:
                found.append(catalog.download(row.url, path, self._fetch))
            except Exception as e:  # one day's failure leaves the other days
                warnings.warn(f"{row.url} wasn't downloaded: {e}", RuntimeWarning, stacklevel=3)
                self.rejected.append((path, str(e)))
        return found

    def _table(self, kind: str, transform: Callable, return_df: bool) -> DataFrame | None:
        """The table of all days' files, which are read twice: once for facts of files, once for the rows.

        Files without rows, or with none left, are rejected; without any other nothing is written.
        """
        dataset = vocab.DATASET_NAMES[self.version][kind]
        facts = lambda raw: flows.file_facts(raw, kind, self.version)
        got = files.scan(self.spark, self._files(dataset), flows.required_columns(kind, self.version), facts=facts)
        self.rejected += got.rejected
        if got.frame is None:
            return None
        name = sinks.table_name(dataset, self.zones, self.start_date, self.end_date, self.version)
        path = sinks.save_table(transform(got.frame, got.facts), os.path.join(self.output_path, name))
        return self.spark.read.parquet(path) if return_df else None

    def get_od_data(self, keep_activity=False, return_df=False, social_agg=False) -> DataFrame | None:
        """Origin-destination flows; saved, and returned if return_df. None where no file is valid."""
        return self._table(
            "od",
            lambda raw, facts: flows.od(raw, keep_activity, social_agg, self.version, hour_mode="auto", facts=facts),
            return_df,
        )

    def get_overnight_stays_data(self, return_df=False) -> DataFrame | None:
        if self.version == 1:
            raise Exception("overnight stays are not part of generation 1")
        return self._table("overnight", lambda raw, facts: flows.overnight(raw, facts=facts), return_df)

    def get_number_of_trips_data(self, return_df=False) -> DataFrame | None:
        return self._table("trips", lambda raw, facts: flows.trips(raw, self.version, facts=facts), return_df)


_output = output_directory


class Zones:
    """Zone shapes with names and population, and relations between units; nothing is read before it is asked for."""

    def __init__(
        self,
        zones: str = "municipalities",
        version: int = 2,
        output_directory: str | None = None,
        spark: SparkSession | None = None,
        fetch: Callable[[str], bytes] = catalog.fetch_url,
        feed: Callable[[int], bytes] | None = None,
    ):
        vocab.check_version(version)
        vocab.check_zone(zones, version)
        self.version, self.zones = version, vocab.zone_name(zones)
        self.output_path = _output(output_directory)
        self._spark, self._fetch, self._feed = spark, fetch, feed
        self._links: list[str] | None = None
        self._ready = False
        self._zones: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.builder.getOrCreate()

    def links(self) -> list[str]:
        """Distinct links of the files that the zone level needs, as the catalog lists them."""
        if self._links is None:
            xml = self._feed(self.version) if self._feed else self._fetch(catalog.FEEDS[self.version])
            wanted = catalog.zoning_catalog(catalog.feed_items(self.spark, xml), self.version, self.zones)
            self._links = list(dict.fromkeys(r.link for r in wanted.collect() if r.link))
        return self._links

    def ensure_files(self) -> None:
        if self._ready:
            return
        for link in self.links():
            path = os.path.join(self.output_path, link.rsplit("/", 1)[-1])
            if not os.path.exists(path):
                catalog.download(link, path, self._fetch)
            if self.version == 1 and path.endswith(".zip"):
                files.unzip(path, self.output_path)
        self._ready = True

    def _file(self, name: str) -> str:
        return files.resolve_file(name, self.output_path, get_data_directory())

    def get_zone_geodataframe(self) -> DataFrame:
        """The zone table, with geometry_wkb in degrees; kept in memory, and on disk as GeoJSON."""
        if self._zones is not None:
            return self._zones
        self.ensure_files()
        cached = os.path.join(self.output_path, f"{self.zones}_{self.version}.geojson")
        if os.path.exists(cached):
            self._zones = shapes.read_geojson(self.spark, cached).cache()
            return self._zones
        if self.version == 2:
            names = files.read_zone_column(self.spark, self._file(f"nombres_{self.zones}.csv"), ("ID", "name"))
            people = files.read_zone_column(self.spark, self._file(f"poblacion_{self.zones}.csv"), ("ID", "population"))
            shp = shapes.read_shapefile(self.spark, self._file(f"zonificacion_{self.zones}.shp"))
            table = zone_ops.zone_table(names, people, shp)
        else:
            folder = os.path.join(self.output_path, f"zonificacion-{self.zones}")
            stem = f"{self.zones}_mitma.shp"
            path = os.path.join(folder, stem)
            path = path if os.path.exists(path) else os.path.join(folder.replace("-", "_"), stem)
            table = zone_ops.zone_table_v1(shapes.read_shapefile(self.spark, path))
        self._zones = table.cache()
        sinks.save_geojson(self._zones, cached)
        return self._zones

    def get_zone_relations(self) -> DataFrame:
        """Generation 2: one row a census section. Generation 1: one row a zone with sets of the related units."""
        self.ensure_files()
        read = lambda name: files.read_relations(self.spark, self._file(name))
        if self.version == 2:
            return zone_ops.relations_v2(read("relacion_ine_zonificacionMitma.csv"))
        return zone_ops.relations_v1(
            read("relaciones_municipio_mitma.csv"), read("relaciones_distrito_mitma.csv"), self.zones
        )

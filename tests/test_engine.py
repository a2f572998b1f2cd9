import gzip
import struct
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from tesela import api
from tesela.functions import normalize as N
from tesela.functions import vocab
from tesela.operators import flows, sinks, zones
from tesela.plans import adapter
from tesela.sources import catalog, files, shapes
from tesela.streaming.flows import file_stream, write_by_date

OD_HEADER = "fecha|periodo|origen|destino|actividad_origen|actividad_destino|residencia|renta|edad|sexo|viajes|viajes_km"
OD_ROWS = [
    "20220101|00|01001|01009|casa|frecuente|01|10-15|25-44|hombre|1|2",
    "20220101|00|01001|01009|trabajo_estudio|no_frecuente|01|>15|25-44|mujer|2|3",
]


def put(path, *lines, bom=False):
    data = ("﻿" if bom else "") + "\n".join(lines) + "\n"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(data)
    return str(path)


def values(spark, expression, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, v string")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_scalars(spark):
    assert values(spark, N.zone_id, ["01001.0", "28.079", "1.2.3", "28079_GAU", " NA ", "\t7\t", None]) == [
        "01001", "28079", "123", "28079_GAU", None, "7", None,
    ]
    assert values(spark, N.iso_date, ["20220101", "2022-01-01", "2022/1/1", "20220101.0", "", "1"]) == [
        "2022-01-01", "2022-01-01", "0020-22-11", "2022-01-01", None, "0000-00-01",
    ]
    assert values(spark, N.number, ["128.457", "1,5", "1d", "NaN", ".5", "-1e2", "x", "inf"]) == [
        128.457, 1.5, None, None, 0.5, -100.0, None, float("inf"),
    ]
    grouped = lambda c: N.number(c, F.lit(True))
    assert values(spark, grouped, ["1.234.567", "2.000", "12,5", "1.23"]) == [1234567.0, 2000.0, 12.5, 1.23]
    assert values(spark, N.grouped_integer, ["1.0", "2214.577", "56.400", "1.234.567", "2.000", "x"]) == [
        1, 2214577, 56400, 1234567, 2, None,
    ]
    assert values(spark, N.trip_label, ["2.0", " 2+ ", "NA"]) == ["2", "2+", "NA"]
    relabelled = values(spark, lambda c: N.relabel(c, vocab.GENDERS), ["hombre", " hombre", "Mujer", None])
    assert relabelled == ["male", " hombre", "Mujer", None]


def test_od_flags_and_files(spark, tmp_path):
    path = put(tmp_path / "a.csv.gz", OD_HEADER, *OD_ROWS, bom=True)
    raw = files.scan(spark, [path], flows.required_columns("od", 2)).frame
    row = flows.od(raw).first()
    assert tuple(row) == ("2022-01-01", 0, "01001", "01009", 3.0, 5.0)
    full = flows.od(raw, True, True)
    assert full.columns == [*flows.OD_KEYS, *flows.ACTIVITY_KEYS, *flows.SOCIAL_KEYS, "n_trips", "trips_total_length_km"]
    assert {(r.activity_origin, r.gender) for r in full.collect()} == {("home", "male"), ("work_or_study", "female")}
    assert flows.od(raw, True, True, version=1).columns == [*flows.OD_KEYS, "n_trips", "trips_total_length_km"]


def test_null_groups_and_missing_activity_columns(spark, tmp_path):
    header = "fecha|periodo|origen|destino|edad|viajes|viajes_km"
    path = put(tmp_path / "a.csv.gz", header, "20220101|1|1|2|NA|1|1", "20220101|1|1|2|0-25|1|1", "20220101|1|1|2|0-25|NA|1")
    raw = files.scan(spark, [path]).frame
    assert flows.od(raw).first().n_trips == 2.0
    assert flows.od(raw, keep_activity=True).count() == 0
    assert flows.od(raw, social_agg=True).count() == 0
    assert flows.od(raw, social_agg=True, keep_null_groups=True).count() == 2


def test_per_file_semantics(spark, tmp_path):
    one = put(tmp_path / "a.csv.gz", "fecha|zona_residencia|zona_pernoctacion|personas", "20220101|1|2|1.234.567", "20220101|1|2|2.000")
    two = put(tmp_path / "b.csv.gz", "personas|FECHA|zona_pernoctacion|zona_residencia|extra", "128.457|20220102|2|1|x")
    found = files.scan(spark, [one, two], flows.required_columns("overnight", 2))
    rows = flows.overnight(found.frame).orderBy("date", "people").collect()
    assert [(r.date, r.residence_area, r.people, r.extra) for r in rows] == [
        ("2022-01-01", "1", 2000.0, None), ("2022-01-01", "1", 1234567.0, None), ("2022-01-02", "1", 128.457, "x"),
    ]
    same = [put(tmp_path / f"{n}.csv.gz", OD_HEADER, *OD_ROWS) for n in "cd"]
    assert flows.od(files.scan(spark, same).frame).count() == 2
    with pytest.raises(Exception, match="generation 1"):
        flows.overnight(found.frame, version=1)


def test_trips(spark, tmp_path):
    v2 = put(tmp_path / "a.csv.gz", "fecha|zona_pernoctacion|edad|sexo|numero_viajes|personas", "20220101|01001.0|25-45|mujer|2+|128.457")
    assert tuple(flows.trips(files.scan(spark, [v2]).frame).first()) == ("2022-01-01", "01001", "25-45", "female", "2+", 128.457)
    v1 = put(tmp_path / "b.txt.gz", "fecha|distrito|numero_viajes|personas", "20200311|01001.0|2.0|1.234")
    out = flows.trips(files.scan(spark, [v1]).frame, version=1)
    assert out.columns == ["date", "overnight_stay_area", "number_of_trips", "people", "age", "gender"]
    assert tuple(out.first()) == ("2020-03-11", "01001", "2", 1.234, None, None)


def test_rejected_files(spark, tmp_path):
    empty = tmp_path / "empty.csv.gz"
    empty.write_bytes(b"")
    good = put(tmp_path / "good.csv.gz", "fecha|x", "20220101|1", "20220102")
    ragged = put(tmp_path / "ragged.csv.gz", "fecha|x", "20220101|1|2")
    lacking = put(tmp_path / "lacking.csv.gz", "x|y", "1|2")
    found = files.scan(spark, [str(empty), good, ragged, lacking, str(tmp_path / "absent")], ("fecha",))
    assert found.accepted == [good] and len(found.rejected) == 4
    assert [(r.fecha, r.x) for r in found.frame.orderBy("fecha").collect()] == [("20220101", "1"), ("20220102", None)]
    assert files.scan(spark, [str(empty)]).frame is None


def test_hour_modes(spark):
    rows = [("20220101", h, "1", "2", "1", "1", f) for h, f in (("00", "a"), ("night", "b"))]
    raw = spark.createDataFrame(rows, "fecha string, periodo string, origen string, destino string, viajes string, viajes_km string, source_file string")
    assert {r.hour for r in flows.od(raw, hour_mode="auto").collect()} == {"00", "night"}
    assert [r.hour for r in flows.od(raw).collect()] == [0]
    assert [r.hour for r in flows.od(raw.where("periodo = '00'"), hour_mode="auto").collect()] == [0]


def feed(*names):
    items = "".join(f"<item><title>{n}</title><link>https://x.org/a/{n}</link><pubDate>now</pubDate></item>" for n in names)
    return f"<rss><channel>{items}</channel></rss>".encode()


def test_catalog(spark, tmp_path):
    (tmp_path / "20230101_Viajes_municipios_v2.csv.gz").write_bytes(b"x")
    (tmp_path / "20230103_Viajes_municipios.csv.gz").write_bytes(b"x")
    items = catalog.feed_items(spark, feed(*(f"2023010{d}_Viajes_municipios.csv.gz" for d in (1, 2, 3)), "202301_x.csv", "notes.pdf"))
    rows = {r.link.rsplit("/", 1)[1]: r for r in catalog.mobility_catalog(items, 2, str(tmp_path)).collect()}
    assert [rows[f"2023010{d}_Viajes_municipios.csv.gz"].downloaded for d in (1, 2, 3)] == [True, False, True]
    assert rows["202301_x.csv"].data_ym == "2023-01" and rows["202301_x.csv"].data_ymd is None
    assert len(rows) == 4
    assert [r[0] for r in catalog.valid_dates(catalog.mobility_catalog(items)).collect()] == ["2023-01-01", "2023-01-02", "2023-01-03"]
    zoning = catalog.feed_items(spark, feed("zonificacion_municipios.shp", "relacion_ine_zonificacionMitma.csv", "unrelated_file.csv"))
    assert catalog.zoning_catalog(zoning).count() == 2
    assert catalog.zoning_catalog(zoning, zone="districts").count() == 1


def test_vocabulary():
    assert vocab.zone_name("MUNICIPAL") == "municipios"
    assert vocab.dataset_name("os", 2) == "Pernoctaciones" and vocab.dataset_name("nt", 1) == "maestra2"
    for call in (lambda: vocab.check_zone("x", 2), lambda: vocab.check_version(3), lambda: vocab.check_date("2022-1-1"), lambda: vocab.check_dataset("x")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="generation 1"):
        vocab.check_zone("lua", 1)
    with pytest.raises(Exception, match="generation 1"):
        vocab.dataset_name("os", 1)


def test_download(tmp_path):
    path = str(tmp_path / "f")
    assert catalog.download("u", path, lambda _: b"one") == path
    catalog.download("u", path, lambda _: b"two")
    assert open(path, "rb").read() == b"one"
    open(path, "wb").close()
    catalog.download("u", path, lambda _: b"three")
    assert open(path, "rb").read() == b"three"


def test_relations(spark):
    town = spark.createDataFrame([("28079", "28079_M1"), ("28080", "28079_M1")], "municipio string, municipio_mitma string")
    district = spark.createDataFrame([("2807901", "D1", "28079_M1"), ("2807902", "D2", "28079_M1"), ("9", "D9", "none")], "distrito string, distrito_mitma string, municipio_mitma string")
    row = zones.relations_v1(town, district, "municipios").first()
    assert (row.id, row.municipalities, row.census_districts, row.districts_mitma) == ("28079_M1", ["28079", "28080"], ["2807901", "2807902"], ["D1", "D2"])
    rows = {r.id: r for r in zones.relations_v1(town, district, "distritos", keep_nulls=True).collect()}
    assert rows["D1"].municipalities == ["28079", "28080"] and rows["D9"].municipalities == [None]
    v2 = zones.relations_v2(spark.createDataFrame([("1", "NA")], "seccion_ine string, gau_mitma string")).first()
    assert (v2.census_sections, v2.luas_mitma) == ("1", None)


def shapefile(folder, name, ids, rings, prj='GEOGCS["x"]'):
    body = b""
    for k, ring in enumerate(rings):
        xy = np.array(ring, "<f8")
        box = struct.pack("<4d", *xy.min(0), *xy.max(0))
        content = struct.pack("<i", 5) + box + struct.pack("<iii", 1, len(xy), 0) + xy.tobytes()
        body += struct.pack(">ii", k + 1, len(content) // 2) + content
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    (folder / f"{name}.shp").write_bytes(head + body)
    (folder / f"{name}.prj").write_text(prj)
    field = b"ID".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15
    dbf = struct.pack("<BBBBIHH", 3, 24, 1, 1, len(ids), 32 + 32 + 1, 9).ljust(32, b"\0") + field + b"\r"
    (folder / f"{name}.dbf").write_bytes(dbf + b"".join(b" " + i.encode().ljust(8) for i in ids))


def test_zones_end_to_end(spark, tmp_path):
    square = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    shapefile(tmp_path, "zonificacion_municipios", ["01001"], [square])
    (tmp_path / "nombres_municipios.csv").write_text("ID|name\n01001|Town A\n01002|Town B\n")
    (tmp_path / "poblacion_municipios.csv").write_text("01001|1234\n01002|NA\n")
    z = api.Zones("municipalities", 2, str(tmp_path), spark=spark, feed=lambda _: feed())
    rows = {r.id: r for r in z.get_zone_geodataframe().collect()}
    assert (rows["01001"].name, rows["01001"].population, rows["01002"].population) == ("Town A", "1234", None)
    assert shapes.from_wkb(bytes(rows["01001"].geometry_wkb)) == ("Polygon", [[list(map(float, p)) for p in square]])
    assert rows["01002"].geometry_wkb is None
    assert z.get_zone_geodataframe() is z.get_zone_geodataframe()
    again = api.Zones("municipalities", 2, str(tmp_path), spark=spark, feed=lambda _: feed()).get_zone_geodataframe()
    assert {r.id: r.geometry_wkb for r in again.collect()} == {i: r.geometry_wkb for i, r in rows.items()}


def test_reprojection():
    utm30 = 'PROJCS["U",GEOGCS["E",DATUM["D",SPHEROID["GRS 1980",6378137.0,298.257222101]]],PARAMETER["False_Easting",500000.0],PARAMETER["Central_Meridian",-3.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0]]'
    p = shapes.Projection(utm30)
    out = p.to_degrees(np.array([[500000.0, 0.0], [500000.0, 4427757.2190], [440298.94, 4474257.31]]))
    assert np.allclose(out[0], [-3, 0], atol=1e-9) and np.allclose(out[1], [-3, 40], atol=1e-7)
    assert np.allclose(out[2], [-3.7038, 40.4168], atol=2e-3)


def test_mobility_end_to_end(spark, tmp_path):
    listing = feed("20220101_Viajes_municipios.csv.gz", "20220103_Viajes_municipios.csv.gz")
    body = gzip.compress("\n".join([OD_HEADER, *OD_ROWS]).encode())

    def fetch(url):
        if "20220102" in url:
            raise OSError("gone")
        return body

    m = api.Mobility(2, "municipalities", "2022-01-01", "2022-01-03", str(tmp_path), spark=spark, fetch=fetch, feed=lambda _: listing)
    assert m.missing_dates == ["2022-01-02"]
    with pytest.warns(RuntimeWarning):
        out = m.get_od_data(return_df=True)
    assert out.count() == 2 and len(m.rejected) == 1
    assert (tmp_path / "Viajes_municipios_2022-01-01_2022-01-03_v2.parquet").is_dir()
    for bad in ({"backend": "x"}, {"start_date": None}, {"end_date": "2021-01-01"}, {"end_date": "2023-01-01"}):
        with pytest.raises(ValueError):
            api.Mobility(**{"start_date": "2022-01-01", "output_directory": str(tmp_path), "spark": spark, "feed": lambda _: listing} | bad)
    with pytest.raises(RuntimeError):
        api.Mobility(start_date="2022-01-01", spark=spark, feed=lambda _: feed())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.csv.gz", "fecha|zona_residencia|zona_pernoctacion|personas", "20220101|1|2|3")
    columns = ("fecha", "zona_residencia", "zona_pernoctacion", "personas")
    query = write_by_date(file_stream(spark, str(tmp_path / "in"), columns), flows.overnight, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    assert [(r.date, r.people) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(date(2022, 1, 1), 3.0)]


def test_sniffing_and_names(tmp_path):
    for k, sep in enumerate("|,;\t"):
        path = tmp_path / str(k)
        path.write_text(f"a{sep}b\n1{sep}2\n")
        assert files.sniff_delimiter(str(path)) == sep
    assert sinks.table_name("Viajes", "GAU", "a", "b", 2) == "Viajes_GAU_a_b_v2.parquet"
    assert api.output_directory(str(tmp_path)) == str(tmp_path)


def test_one_base_name_in_two_folders(spark, tmp_path):
    header = "fecha|zona_residencia|zona_pernoctacion|personas"
    paths = []
    for folder, rows in (("a b", ["20220101|1|2|1.234.567", "20220101|1|2|2.000"]), ("c%20", ["20220101|1|2|2.000"])):
        (tmp_path / folder).mkdir()
        paths.append(put(tmp_path / folder / "x.csv.gz", header, *rows))
    facts = lambda raw: flows.file_facts(raw, "overnight")
    found = files.scan(spark, paths, flows.required_columns("overnight", 2), facts=facts)
    assert found.accepted == paths and found.facts.num_rows == 2
    for rows in (flows.overnight(found.frame), flows.overnight(found.frame, facts=found.facts)):
        assert sorted(r.people for r in rows.collect()) == [2.0, 2000.0, 1234567.0]
    od = [put(tmp_path / f / "y.csv.gz", OD_HEADER, OD_ROWS[0]) for f in ("a b", "c%20")]
    assert [r.n_trips for r in flows.od(files.scan(spark, od).frame, sort=True).collect()] == [1.0, 1.0]


def test_files_without_rows_are_rejected(spark, tmp_path):
    header = put(tmp_path / "header.csv.gz", OD_HEADER)
    nothing = put(tmp_path / "nothing.csv.gz", OD_HEADER, "20220101|00|NA|01009|casa|casa|01|x|y|z|1|2", "NULL|00|1|2|||||||1|1")
    good = put(tmp_path / "good.csv.gz", OD_HEADER, *OD_ROWS)
    facts = lambda raw: flows.file_facts(raw, "od")
    found = files.scan(spark, [header, nothing, good], flows.required_columns("od", 2), facts=facts)
    assert found.accepted == [good]
    assert found.rejected == [(header, "no data rows"), (nothing, "no valid rows")] and found.facts.num_rows == 1
    assert files.scan(spark, [header, nothing], facts=facts).frame is None
    listing = feed("20220101_Viajes_municipios.csv.gz")
    body = gzip.compress((OD_HEADER + "\n").encode())
    m = api.Mobility(2, "municipalities", "2022-01-01", None, str(tmp_path), spark=spark, fetch=lambda _: body, feed=lambda _: listing)
    assert m.get_od_data(return_df=True) is None and [r for _, r in m.rejected] == ["no data rows"]
    assert not list(tmp_path.glob("*.parquet"))


def test_raw_tokens_of_no_value_and_hours_of_files(spark):
    rows = [("20220101", h, o, "2", v, "1", f) for h, o, v, f in (
        ("01", "1", "1", "a"), ("02", "NULL", "1", "a"), ("N/A", "1", "1", "a"), ("03", "1", "NaN", "b"), ("04", "1", "2.000", "b"),
        ("05", "1", "1.000.000", "b"), ("06", "1", "5.000", "a"),
    )]
    raw = spark.createDataFrame(rows, "fecha string, periodo string, origen string, destino string, viajes string, viajes_km string, source_file string")
    got = {r.hour: r.n_trips for r in flows.od(raw).collect()}
    assert got == {1: 1.0, 4: 2000.0, 5: 1e6, 6: 5.0}
    assert {r.hour for r in flows.od(raw, hour_mode="auto").collect()} == {"01", "04", "05", "06"}


def test_download_needs_a_body(tmp_path, monkeypatch):
    with pytest.raises(OSError, match="empty body"):
        catalog.download("u", str(tmp_path / "x" / "f"), lambda _: b"")
    assert list((tmp_path / "x").iterdir()) == []
    asked = []

    class Response:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return b"body"

    def opened(request, timeout):
        asked.append((request.full_url, request.get_header("User-agent"), timeout))
        return Response()

    monkeypatch.setattr(catalog.urllib.request, "urlopen", opened)
    assert catalog.fetch_url("https://x.org/a") == b"body"
    assert asked == [("https://x.org/a", catalog.USER_AGENT, catalog.TIMEOUT_SECONDS)]


def test_projections_that_are_not_supported():
    spheroid = 'SPHEROID["GRS 1980",6378137.0,298.257222101]'
    system = 'PROJCS["P",GEOGCS["E",DATUM["D",%s],UNIT["Degree",0.0174532925199433]],PROJECTION["%s"],PARAMETER["Central_Meridian",-3.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["False_Easting",%s],UNIT["U",%s]]'
    with pytest.raises(ValueError, match="Lambert"):
        shapes.Projection(system % (spheroid, "Lambert_Conformal_Conic", "500000", "1.0"))
    with pytest.raises(ValueError, match="ellipsoid"):
        shapes.Projection(system % ('SPHEROID["International 1924",6378388.0,297.0]', "Transverse_Mercator", "500000", "1.0"))
    with pytest.raises(ValueError, match="degrees"):
        shapes.Projection('GEOGCS["E",DATUM["D",%s],UNIT["Grad",0.015707963267949]]' % spheroid)
    metres, kilometres = (shapes.Projection(system % (spheroid, "Transverse_Mercator", x, u)) for x, u in (("500000", "1.0"), ("500", "1000.0")))
    point = np.array([[440298.94, 4474257.31]])
    assert np.allclose(metres.to_degrees(point), kilometres.to_degrees(point / 1000), atol=1e-9)


def test_files_in_parts(spark, tmp_path):
    """A folder of parts is one file: its facts and sums hold for all parts, and faults of one part reject it."""
    header = "fecha|periodo|origen|destino|viajes|viajes_km"

    def parts(name, *bodies):
        (tmp_path / name).mkdir()
        for k, lines in enumerate(bodies):
            put(tmp_path / name / f"part-{k}.csv.gz", *lines)
        (tmp_path / name / "_SUCCESS").write_bytes(b"")
        return str(tmp_path / name)

    rows = ["20220101|00|1|2|2.000|1", "20220101|00|1|2|1.234.567|1"]
    whole = put(tmp_path / "whole.csv.gz", header, rows[0])
    good = parts("a b", [header, rows[0]], [header, rows[1]], [header])
    ragged = parts("ragged", [header, rows[0]], [header, rows[0] + "|1"])
    mixed = parts("mixed", [header, rows[0]], ["fecha|periodo|origen|destino|viajes_km|viajes", rows[0]])
    facts = lambda raw: flows.file_facts(raw, "od")
    paths = [whole, good, ragged, mixed, parts("none")]
    found = files.scan(spark, paths, flows.required_columns("od", 2), facts=facts)
    assert sorted(found.accepted) == sorted([whole, good]) and found.facts.num_rows == 2
    assert [p for p, _ in found.rejected if p in paths] == [mixed, paths[-1], ragged]
    assert sorted(r.n_trips for r in flows.od(found.frame, facts=found.facts).collect()) == [2.0, 1236567.0]


def test_tasks_do_not_grow_with_the_tables(spark, tmp_path, monkeypatch):
    """Rows come in partitions by the size of the tables, and files are written in parts of a bounded number of rows."""
    spark.range(10_000).selectExpr("id AS c_custkey", "uuid() AS c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = lambda: adapter.raw(spark, str(tmp_path), "SELECT c_custkey, c_name FROM customer")
    assert rows().rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(adapter, "PARTITION_BYTES", 20_000)
    monkeypatch.setattr(adapter, "PART_ROWS", 300)
    assert rows().rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    path = adapter.as_parts(rows(), str(tmp_path), "f", sep="|", compression="gzip")
    assert len(files.parts_of(path)) >= 34
    found = files.scan(spark, [path])
    assert [files._local_path(r.source_file) for r in found.frame.select("source_file").distinct().collect()] == [path]
    assert found.frame.selectExpr("count(*)", "sum(c_custkey)").first() == (10_000, 49_995_000)


def test_cheap_tests_of_fields_change_nothing(spark):
    fields = [*vocab.RAW_NULLS, "1.#IND ", " 1.#QNAN", "1.#x", " NA ", "\t7", "7\n", "1,5", " 2", "x", "NA7", "1.5.", "1.234.567", " 1.234,567\t", "123.456"]
    old_number = lambda c: F.coalesce(F.translate(N.trim_all(c), ",", ".").rlike(N.IS_NUMBER), F.lit(False))
    old_known = lambda c: F.coalesce(~c.isin(*vocab.RAW_NULLS) & ~N.trim_all(c).isin(*vocab.TRIMMED_NULLS), F.lit(False))
    old_thousands = lambda c: F.coalesce(F.translate(N.trim_all(c), ",", ".").rlike(N.GROUPED_TWICE), F.lit(False))
    for new, old in ((N.is_number, old_number), (N.is_known, old_known), (N.has_thousands, old_thousands)):
        assert values(spark, new, [*fields, None]) == values(spark, old, [*fields, None])

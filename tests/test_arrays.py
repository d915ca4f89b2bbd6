"""The labelled-array data source against NumPy: layouts, pushed filters, labels, writing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrgrid.sources import arrays, products

CODES = {v: k for k, v in products.DTYPES.items()}
CORNERS = {"upper_left": (10.0, 1.0), "upper_right": (10.1, 1.0), "lower_right": (10.1, 0.9), "lower_left": (10.0, 0.9)}


def write(folder, data, name="src", dtype=">u2", axes=("Line", "Sample"), offset=0, scaling=None, special=None, gsd=(1.0, "m/pixel"), corners=None, bbox=None, case=str):
    (folder / case(f"{name}.dat")).write_bytes(b"\7" * offset + np.ascontiguousarray(data, dtype).tobytes())
    tags = lambda d: "".join(f"<{k}>{v}</{k}>" for k, v in d.items())
    shown = "".join(f"<Axis_Array>{tags({'axis_name': n, 'elements': k, 'sequence_number': i})}</Axis_Array>" for i, (n, k) in enumerate(zip(axes, data.shape), 1))
    geometry = tags({f"{c}_{part}": x for c, pair in (corners or {}).items() for part, x in zip(("longitude", "latitude"), pair)}) + tags({f"{s}_bounding_coordinate": x for s, x in zip(("west", "south", "east", "north"), bbox or ())})
    scale = tags(dict(zip(("scaling_factor", "value_offset"), scaling or ())))
    (folder / f"{name}.xml").write_text(f"""<Product_Observational xmlns="urn:p" xmlns:i="urn:i"><Identification_Area><Other><file_name>preview.png</file_name></Other></Identification_Area>
        <Observing_System_Component><name>Orbiter</name><type>Spacecraft</type></Observing_System_Component><Observing_System_Component><name>High Camera</name><type>Instrument</type></Observing_System_Component>
        <i:solar_incidence_angle>70.0</i:solar_incidence_angle>{f'<i:ground_sample_distance unit="{gsd[1]}">{gsd[0]}</i:ground_sample_distance>' if gsd else ''}{geometry}
        <File_Area_Observational><File><file_name>{name}.dat</file_name></File><Array_{data.ndim}D_Image><offset unit="byte">{offset}</offset><axis_index_order>Last Index Fastest</axis_index_order>
        <Element_Array><data_type>{CODES[dtype]}</data_type>{scale}</Element_Array>{shown}{f'<Special_Constants>{tags(special)}</Special_Constants>' if special else ''}</Array_{data.ndim}D_Image></File_Area_Observational></Product_Observational>""")
    return str(folder / f"{name}.xml")


def cube(df, shape):
    out = np.full(shape, np.inf)
    for r in df.collect():
        at = (r.row, r.col) if len(shape) == 2 else (r.band, r.row, r.col)
        assert out[at] == np.inf
        out[at] = np.nan if r.v is None else r.v
    return out


@pytest.mark.parametrize("dtype", sorted(CODES))
def test_every_element_type_at_any_byte(spark, tmp_path, dtype):
    kind = np.dtype(dtype)
    data = np.arange(12 * 7).reshape(12, 7).astype(kind) + (np.iinfo(kind).max - 100 if kind.kind in "iu" and kind.itemsize < 8 else 0)
    label = write(tmp_path, data, dtype=dtype, offset=61)
    assert (cube(arrays.read_arrays(spark, label), (12, 7)) == data.astype(float)).all()


@pytest.mark.parametrize("axes", [("Line", "Band", "Sample"), ("Band", "Line", "Sample"), ("Line", "Sample", "Band"), ("Sample", "Band", "Line"), ("a", "b", "c")])
def test_cubes_in_any_order(spark, tmp_path, axes):
    size = {"Line": 5, "Band": 3, "Sample": 4, "a": 3, "b": 5, "c": 4}
    data = np.random.default_rng(0).random([size[a] for a in axes])
    label = write(tmp_path, data, dtype=">f8", axes=axes)
    order = [axes.index(a) for a in ("Band", "Line", "Sample")] if axes[0] != "a" else [0, 1, 2]
    want = np.moveaxis(data, order, [0, 1, 2])
    df = arrays.read_arrays(spark, label)
    assert (cube(df, (3, 5, 4)) == want).all()
    assert (cube(df.where("row >= 1 and row < 3 and band in (0, 2)").withColumn("band", (F.col("band") / 2).cast("int")).withColumn("row", F.col("row") - 1), (2, 2, 4)) == want[::2, 1:3]).all()


def test_scale_and_special_constants(spark, tmp_path):
    label = write(tmp_path, np.array([[1, 2], [0, 4]]), dtype="<i2", gsd=(0.005, "km/pixel"), scaling=(0.5, 10.0), special={"missing_constant": "0x0", "valid_maximum": "4"})
    got = cube(arrays.read_arrays(spark, label), (2, 2))
    assert got[0].tolist() == [10.5, 11.0] and np.isnan(got[1, 0]) and got[1, 1] == 12.0
    bad = write(tmp_path, np.array([[np.nan, np.inf, 1.0]]), "bad", dtype="<f4")
    assert np.isnan(cube(arrays.read_arrays(spark, bad), (1, 3)))[0].tolist() == [True, True, False]


def test_pushed_filters_read_fewer_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "STRIP_BYTES", 200)
    data = np.arange(40 * 3 * 10).reshape(40, 3, 10)
    label = write(tmp_path, data, axes=("Line", "Band", "Sample"))
    write(tmp_path, data, "other", axes=("Line", "Band", "Sample"))

    def planned(*filters):
        reader = arrays.ArrayReader({"path": str(tmp_path)})
        rest = list(reader.pushFilters(list(filters)))
        return sum(p.bytes for p in reader.partitions()), rest

    whole, _ = planned()
    assert whole == 2 * data.size * 2
    some, rest = planned(arrays.GreaterThan(("row",), 9), arrays.LessThanOrEqual(("row",), 19), arrays.IsNotNull(("row",)))
    assert some == whole // 4 and rest == []
    assert planned(arrays.EqualTo(("label_path",), label))[0] == whole // 2
    assert planned(arrays.EqualTo(("row",), 50))[0] == 0 and planned(arrays.EqualTo(("band",), 7))[0] == 0
    assert planned(arrays.In(("row",), (3, 4)))[0] == whole // 20
    bsq = write(tmp_path, data.transpose(1, 0, 2).copy(), "bsq", axes=("Band", "Line", "Sample"))
    one = planned(arrays.EqualTo(("label_path",), bsq), arrays.EqualTo(("band",), 1))[0]
    assert one == whole // 6
    monkeypatch.undo()
    df = arrays.read_arrays(spark, str(tmp_path)).where(F.col("row").between(10, 19) & (F.col("label_path") == label) & (F.col("col") == 3))
    assert {(r.row, r.band): r.v for r in df.collect()} == {(r, b): float(data[r, b, 3]) for r in range(10, 20) for b in range(3)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.where("row in (10, 12)").count() == 6 and "Filter" in plan and plan.count("row#") and "row# >=" not in plan


def test_labels_tell_geometry(spark, tmp_path):
    write(tmp_path, np.zeros((100, 100)), "box", gsd=None, bbox=(0.0, 0.0, 0.1, 0.1))
    write(tmp_path, np.zeros((4, 4)), "corners", corners={k: (x + 340.0, y) for k, (x, y) in CORNERS.items()}, gsd=(250, "mm"))
    got = {r.label_path.rsplit("/", 1)[-1]: r for r in products.read_labels(spark, str(tmp_path)).collect()}
    box, corners = got["box.xml"], got["corners.xml"]
    assert (box.gsd_m, box.instrument, box.data_file, box.metadata) == (None, "High Camera", "box.dat", {"solar_incidence_angle": 70.0}) and tuple(box.bbox) == pytest.approx((0.0, 0.0, 0.1, 0.1))
    assert corners.gsd_m == pytest.approx(0.25) and corners.bbox.min_lon == pytest.approx(-10.0) and corners.corners["upper_left"].lon == pytest.approx(-10.0)


def test_errors(spark, tmp_path):
    with pytest.raises(Exception, match="no label"):
        arrays.read_arrays(spark, str(tmp_path / "missing.xml")).count()
    (tmp_path / "bad.xml").write_text("<Product_Observational><unclosed>")
    with pytest.raises(Exception, match="malformed"):
        arrays.read_arrays(spark, str(tmp_path / "bad.xml")).count()
    label = write(tmp_path, np.zeros((8, 8)))
    (tmp_path / "src.dat").write_bytes(b"\0" * 10)
    with pytest.raises(Exception, match="holds 10 bytes"):
        arrays.read_arrays(spark, label).count()
    (tmp_path / "src.dat").unlink()
    with pytest.raises(Exception, match="no data file"):
        arrays.read_arrays(spark, label).count()


def test_data_files_may_differ_in_case_and_labels_be_read_in_tasks(spark, tmp_path):
    a, b = np.arange(30).reshape(5, 6), np.arange(8).reshape(2, 4)
    write(tmp_path, a, "one", case=str.upper)
    write(tmp_path, b, "two", offset=3)
    (tmp_path / "broken.xml").write_text("<x")
    got = arrays.read_labelled(products.read_labels(spark, str(tmp_path)))
    assert (cube(got.where("label_path like '%one.xml'"), (5, 6)) == a).all() and (cube(got.where("label_path like '%two.xml'"), (2, 4)) == b).all() and got.count() == 38


def test_written_products_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    a = np.array([[1.5, np.nan], [3.0, -4.0]], "<f4")
    rows = [("a", 2, 2, bytearray(a.tobytes())), ("b", 1, 3, bytearray(np.arange(3, dtype="<f4").tobytes()))]
    df = spark.createDataFrame(rows, "name string, rows int, cols int, values binary")
    arrays.write_arrays(df, path)
    got = arrays.read_arrays(spark, path)
    assert np.array_equal(cube(got.where("label_path like '%/a.xml'"), (2, 2)), a.astype(float), equal_nan=True) and got.count() == 7
    with pytest.raises(Exception, match="values for"):
        arrays.write_arrays(df.withColumn("rows", F.lit(9)).withColumn("name", F.lit("c")), path)
    assert arrays.read_arrays(spark, path).count() == 7  # a failed job shows nothing
    arrays.write_arrays(df.where("name = 'b'"), path, mode="overwrite")
    assert arrays.read_arrays(spark, path).count() == 3
    assert json.loads(json.dumps(arrays.asdict(arrays.ArrayReader({"path": path}).partitions()[0])))["first"] == 0

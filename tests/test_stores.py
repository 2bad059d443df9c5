import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import equivalence, station
from stratagrid.session import fresh_path
from stratagrid.sources import observations, room, scans, tier, tilestore

ROWS, COLS = 40, 60


@pytest.fixture(scope="module")
def mesh(spark):
    lattice = station.Lattice(ROWS, COLS, 2 * math.pi / COLS, math.radians(120) / (ROWS - 1))
    found = station.mesh_station(room.room_scan(spark, rows=ROWS, cols=COLS), lattice, station.Rules(noise_floor=0.6))
    vertices = found.vertices().withColumn("sample_id", F.col("sample_id") + 7_000_000_000).cache()
    return vertices, found.triangles.select("c0", "c1", "c2").cache(), found, lattice


@pytest.fixture(scope="module")
def store(spark, mesh):
    root = fresh_path(spark, "test-tiles")
    tilestore.write(root, mesh[0], mesh[1], tilestore.Windows(COLS, 16, 16))
    return root, tilestore.open_store(spark, root)


def test_tiles_make_the_mesh_again(mesh, store):
    vertices, triangles, _, _ = mesh
    got, faces = store[1].mesh()
    place = {r["gid"]: (r["x"], r["y"], r["z"]) for r in vertices.collect()}
    assert {r["gid"]: (r["x"], r["y"], r["z"]) for r in got.collect()} == place
    gid = {r["cell"]: r["gid"] for r in vertices.collect()}
    assert sorted(map(tuple, faces.collect())) == sorted(tuple(gid[c] for c in r) for r in triangles.collect())
    named = store[1].triangles(identity=True).collect()
    sample = {r["gid"]: r["sample_id"] for r in vertices.collect()}
    assert all(r["s1"] == sample[r["g1"]] and tuple(r["p2"]) == place[r["g2"]] for r in named)
    tile = store[1].manifest.orderBy(F.desc("triangle_count")).first()
    own, inner = store[1].tile(tile["tile_id"])
    assert (own.count(), inner.count()) == (tile["vertex_count"], tile["triangle_count"])
    assert own.where("owned").agg(F.max("slot")).first()[0] == tile["owned_count"] - 1
    wanted = got.limit(5).select("gid")
    assert store[1].vertices_of(wanted).count() == 5


def test_files_do_not_grow_with_tiles(spark, mesh, tmp_path):
    root = str(tmp_path / "tiles")
    tilestore.write(root, mesh[0], mesh[1], tilestore.Windows(COLS, 2, 2))
    own = tilestore.open_store(spark, root)
    tiles = own.manifest.count()
    for table in ("vertices", "triangles", "identity"):
        files = list((tmp_path / "tiles").glob(f"gen-*/{table}/**/*.parquet"))
        assert 0 < len(files) <= 10 < tiles
    some = own.manifest.where("triangle_count > 0").first()
    vertices, triangles = own.tile(some["tile_id"])
    assert (vertices.count(), triangles.count()) == (some["vertex_count"], some["triangle_count"])
    assert f"EqualTo(tile_id,{some['tile_id']})" in triangles._jdf.queryExecution().executedPlan().toString()
    assert own.mesh()[0].count() == mesh[0].count()


def test_generations(spark, mesh, store):
    root, first = store
    before = first.path
    tilestore.write(root, mesh[0], mesh[1], tilestore.Windows(COLS, 8, 30))
    now = tilestore.open_store(spark, root)
    assert now.path != before and now.windows.tile_rows == 8
    assert tilestore.remove_generations(spark, root) == 1
    assert tilestore.open_store(spark, root).mesh()[0].count() == mesh[0].count()
    with pytest.raises(FileNotFoundError):
        tilestore.open_store(spark, fresh_path(spark, "no-tiles"))


@pytest.mark.parametrize("table", ["vertices", "triangles", "identity", "manifest"])
def test_changed_tiles_do_not_open(spark, mesh, tmp_path, table):
    root = str(tmp_path / "tiles")
    tilestore.write(root, mesh[0], mesh[1], tilestore.Windows(COLS, 16, 16))
    path = f"{root}/{json.loads((tmp_path / 'tiles' / 'current.json').read_text())['generation']}"
    rows = spark.read.parquet(f"{path}/{table}")
    changed = rows.orderBy("tile_id").limit(rows.count() - 1) if table == "manifest" else rows.where("tile_id <> 5") if rows.where("tile_id = 5").count() else rows.limit(rows.count() - 1)
    copy = fresh_path(spark, "changed")
    changed.write.parquet(copy)
    writer = spark.read.parquet(copy).write.mode("overwrite")
    (writer if table == "manifest" else writer.partitionBy("tile_id")).parquet(f"{path}/{table}")
    with pytest.raises(ValueError):
        tilestore.open_store(spark, root)


def test_patches(mesh, store):
    windows = store[1].windows
    vertices, faces = tilestore.window_patches(store[1], 2, 2)
    assert faces.count() == mesh[1].count() and vertices.where("owned").count() == mesh[0].count()
    for r in vertices.groupBy("patch").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("gid").alias("d")).collect():
        assert r["n"] == r["d"] == r["last"] + 1
    ground, cells = tilestore.ground_patches(store[1], 2.0)
    assert cells.count() == mesh[1].count() and ground.where("owned").count() == mesh[0].count()
    planned = tilestore.plan(store[1].manifest, windows.across, 2, 2)
    assert tilestore.oversize(store[1].manifest, planned, 10).count() > 0 == tilestore.oversize(store[1].manifest, planned, 10**6).count()


def test_cubes(spark, mesh):
    cubes = tilestore.covering(mesh[0], 1.5)
    x, y, z = (F.col(k) for k in "xyz")
    for r in mesh[0].withColumn("tile", cubes.of(x, y, z)).limit(200).collect():
        low, high = cubes.bounds(r["tile"])
        assert all(a - 1e-6 <= r[k] <= b + 1e-6 for a, b, k in zip(low, high, "xyz", strict=True))
    with pytest.raises(ValueError):
        tilestore.Cubes.covering([0.0] * 3, [1e4] * 3, 1.0)
    row, col = tilestore.Windows(100, 16, 16).first_cell(F.lit(9))
    assert tuple(spark.range(1).select(row, col).first()) == (16, 32)


def test_observations(spark, mesh):
    _, _, found, lattice = mesh
    path = fresh_path(spark, "observations")
    observations.write(observations.observations(found.samples, lattice, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), path)
    rows = observations.read(spark, path)
    every = rows.orderBy("ordinal").collect()
    kept = found.samples.where("disposition = 'retained'").orderBy("cell").collect()
    assert [r["sample_id"] for r in every] == [r["sample_id"] for r in kept]
    assert all(r["x"] == pytest.approx(-s["y"]) and r["azimuth"] == pytest.approx(-math.pi + s["col"] * lattice.az_step, abs=1e-5) for r, s in zip(every, kept, strict=True))
    window = observations.row_range(rows, 5, 9)
    assert sorted(r["ordinal"] for r in window.collect()) == [k for k, s in enumerate(kept) if 5 <= s["row"] <= 9]
    assert "PushedFilters: [IsNotNull(row), GreaterThanOrEqual(row,5), LessThanOrEqual(row,9)]" in window._jdf.queryExecution().executedPlan().toString()
    rng = random.Random(1)
    asked = [(k, rng.randrange(len(kept))) for k in range(60)]
    got = observations.gather(rows, spark.createDataFrame(asked, "request long, ordinal long")).collect()
    assert [(r["request"], r["ordinal"]) for r in got] == asked and all(r["row"] == kept[r["ordinal"]]["row"] for r in got)
    with pytest.raises(Exception, match="no observation"):
        observations.gather(rows, spark.createDataFrame([(0, 10**6)], "request long, ordinal long")).collect()
    with pytest.raises(Exception):
        observations.write(rows, path)
    assert sum(r["count"] for r in observations.row_index(rows).collect()) == len(kept)


def test_codecs():
    rng = np.random.default_rng(3)
    for array in (rng.normal(size=(50, 3)).astype("<f4"), rng.integers(0, 2**32, (40, 3), dtype=np.uint32), np.zeros((0, 3), "<u4"), rng.integers(-(2**40), 2**40, (9, 1))):
        assert (tier.byte_unshuffle(tier.byte_shuffle(array), array.dtype.str, array.shape) == array).all()
        for codec in (tier.STORED, tier.PACKED):
            assert (tier.unpack(tier.pack(array, codec), array.dtype.str, array.shape, codec) == array).all()
    rows = rng.integers(0, 2**32, (30, 3), dtype=np.uint32)
    assert (tier.undelta_rows(tier.delta_rows(rows)) == rows).all()


def test_what_may_not_be_written():
    points, faces, own = np.zeros((3, 3)), np.array([[0, 1, 2]]), tier.Tier(0, 2, 1.0)
    for job in (
        lambda: tier.encode(own, 1, points, faces + 1, 0.0, None), lambda: tier.encode(own, 1, points, faces, -1.0, None), lambda: tier.encode(own, 1, points * np.nan, faces, 0.0, None),
        lambda: tier.encode(own, 1, points, faces, 0.0, np.arange(3)), lambda: tier.Tier(2, 2, 1.0).check(), lambda: tier.Tier(0, 2, 0.0).check(), lambda: tier.Tier(0, 1, 1.0, audience=7).check(),
    ):
        with pytest.raises(ValueError):
            job()
    content, _ = tier.encode(own, 1, points, faces, 0.5, None)
    assert tier.header(content)["bound"] == 0.5
    for broken in (content[:-1], content[:40], b"x" + content[1:]):
        with pytest.raises(ValueError):
            tier.entries(broken)


@pytest.mark.parametrize("codec", [tier.STORED, tier.PACKED])
def test_identity_is_found_where_it_is_and_nowhere_else(spark, mesh, codec):
    vertices, triangles, _, _ = mesh
    faces = triangles.withColumn("tile_id", F.floor(F.col("c0") / (COLS * 16)))
    named = faces.select("tile_id", F.explode(F.array("c0", "c1", "c2")).alias("cell")).distinct().join(vertices.select("cell", "sample_id"), "cell")
    for audience in (tier.CLIENT, tier.CHECK):
        encoded = tier.tiles(faces, vertices, tier.Tier(0, 1, 1.0, audience, codec)).cache()
        found = [r["found"] for r in tier.audit(encoded, named).collect()]
        assert all(n == 0 for n in found) if audience == tier.CLIENT else all(n > 0 for n in found)
        said = tier.described(encoded).collect()
        assert all(r["balanced"] and r["audience"] == audience and ("sample" in r["arrays"]) == (audience == tier.CHECK) for r in said)
        read = tier.unpacked(encoded)
        assert read.count() == named.count()
        if audience == tier.CHECK:
            far = read.join(vertices.select("sample_id", *[F.col(k).alias(f"v{k}") for k in "xyz"]), "sample_id").agg(F.max(F.greatest(*[F.abs(F.col(k) - F.col(f"v{k}")) for k in "xyz"]))).first()[0]
            assert far < 1e-5


def test_equivalence(spark, mesh):
    _, triangles, found, lattice = mesh
    assert equivalence.require(equivalence.stations(found, found)).count() == 4
    turned = triangles.select(F.col("c1").alias("c0"), F.col("c2").alias("c1"), F.col("c0").alias("c2"))
    flipped = triangles.select("c0", F.col("c2").alias("c1"), F.col("c1").alias("c2"))
    assert equivalence.triangles("t", triangles, turned).first()["differing"] == 0
    assert equivalence.triangles("t", triangles, flipped).first()["differing"] > 0
    assert equivalence.triangles("t", triangles.unionByName(triangles.limit(1)), triangles).first()["differing"] == 1
    zero = spark.createDataFrame([(0.0, 1)], "a double, b int")
    assert equivalence.rows("r", zero, spark.createDataFrame([(-0.0, 1)], "a double, b int")).first()["differing"] > 0
    assert equivalence.rows("r", zero, zero.withColumn("a", F.col("a").cast("float"))).first()["differing"] == 1
    normals = found.samples.where("disposition = 'retained'")
    moved = normals.withColumn("nx", F.when(F.col("row") == 20, F.col("nx") + 0.01).otherwise(F.col("nx")))
    assert equivalence.normals("n", normals, moved).first()["differing"] > 0
    with pytest.raises(AssertionError, match="such as"):
        equivalence.require([equivalence.normals("n", normals, moved)])


def _raw(spark, frame="local", spherical=False, rows=24, cols=90, partial=1.0):
    """A scan as a structured file has it, with flags, colours and cells that did not return."""
    own = room.room_scan(spark, room.Room(mover=False), rows, cols, noise=0.0).where(F.col("col") < cols * partial)
    place = (list(room.Room().scanner), scans.rotation_of((math.cos(0.3), 0.0, 0.0, math.sin(0.3))))
    place[0][0] += 5_000.0
    xyz = [F.col(k).cast("double") for k in "xyz"]
    world = [sum((F.lit(place[1][i][j]) * xyz[j] for j in range(3)), F.lit(place[0][i])) for i in range(3)]
    # Angles as a file has them, a few digits.
    azimuth, elevation = F.round(F.atan2(xyz[1], xyz[0]), 4), F.round(F.asin(xyz[2] / F.col("rng")), 4)
    fields = dict(zip(scans.SPHERICAL, (F.col("rng").cast("double"), azimuth, elevation), strict=True)) if spherical else dict(zip(scans.CARTESIAN, world if frame == "world" else xyz, strict=True))
    if not spherical:
        fields |= {"rowIndex": F.col("row"), "columnIndex": F.col("col")}
    table = own.select(F.lit("E").alias("station_id"), "sample_id", *[c.alias(n) for n, c in fields.items()], (F.col("r") * 257).cast("int").alias("colorRed"), (F.col("g") * 257).cast("int").alias("colorGreen"), (F.col("b") * 257).cast("int").alias("colorBlue"), F.lit(0.5).alias("intensity"), F.lit(0).alias("cartesianInvalidState"))
    bad = table.limit(3).withColumn("sample_id", F.col("sample_id") + 10**6).withColumn("cartesianInvalidState", F.lit(2))
    stations = spark.createDataFrame([("E", *place)], "station_id string, t array<double>, rot array<array<double>>")
    return own, table.unionByName(bad), stations


@pytest.mark.parametrize(("frame", "path"), [("local", "left_as_local"), ("world", "rewritten_to_local")])
def test_raw_scans_come_into_the_scanners_frame(spark, frame, path):
    own, raw, stations = _raw(spark, frame)
    samples, described = scans.read_stations(raw, stations)
    row = described.first()
    assert (row["path"], row["tier"], row["dropped_no_return"]) == (path, "row_column", 3)
    assert (row["rows"], row["cols"]) == (24, 90) and row["az_step"] == pytest.approx(2 * math.pi / 90, rel=1e-3)
    both = own.select("sample_id", *[F.col(k).alias(f"w{k}") for k in "xyz"], F.col("row").alias("wrow")).join(samples, "sample_id")
    assert both.count() == own.count()
    assert both.agg(F.max(F.greatest(*[F.abs(F.col(k) - F.col(f"w{k}")) for k in "xyz"]))).first()[0] < 1e-2
    first = samples.first()
    assert max(first["r"], first["g"], first["b"]) <= 255 and first["intensity"] == 32767


def test_lattice_of_angles(spark):
    own, raw, stations = _raw(spark, spherical=True)
    samples, described = scans.read_stations(raw, stations)
    row = described.first()
    assert row["tier"] == "spherical" and row["path"] == "spherical" and row["az_step"] == pytest.approx(2 * math.pi / 90, rel=1e-2)
    strided, told = scans.read_stations(raw, stations, max_points=500)
    k = told.first()["stride"]
    assert k >= 2 and strided.count() == samples.where((F.col("row") % k == 0) & (F.col("col") % k == 0)).count() <= 600


def test_a_partial_sweep_does_not_wrap(spark):
    _, raw, stations = _raw(spark, partial=0.5)
    row = scans.read_stations(raw, stations)[1].first()
    assert not station.Lattice(row["rows"], row["cols"], row["az_step"], row["el_step"]).wraps


def test_fields_and_poses(spark):
    _, raw, _ = _raw(spark)
    assert scans.check_fields(raw, ["rowIndex"]).columns == ["station_id", "sample_id", "rowIndex"]
    for wrong in ([], ["nothing"], ["sphericalRange"]):
        with pytest.raises(ValueError):
            scans.check_fields(raw, wrong)
    assert scans.probe(raw).first()["tier"] == "row_column"
    place, turn = scans.pose_of({"translation": {"x": 1, "y": 2, "z": 3}, "quaternion": {"w": 1, "x": 0, "y": 0, "z": 1}})
    assert place == [1, 2, 3] and np.allclose(turn, [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert scans.pose_of({})[1] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    with pytest.raises(ValueError):
        scans.pose_of({"rotation": [[1, 0, 0], [0, 1, 0], [0, 0, -1]]})
    with pytest.raises(Exception, match="implausible"):
        scans.plausible(spark.createDataFrame([(20_000.0,)], "rng double")).collect()

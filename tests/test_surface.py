import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import decimate, lattice, mesh, surface
from stratagrid.sources import las

#: A tetrahedron, outwards.
POINTS = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]
FACES = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]


@pytest.fixture
def solid(spark):
    return spark.createDataFrame(FACES, "c0 long, c1 long, c2 long"), spark.createDataFrame(POINTS, "cell long, x double, y double, z double")


def test_normals_and_quadrics(spark, solid):
    own = {r["cell"]: (r["nx"], r["ny"], r["nz"]) for r in surface.vertex_normals(*solid).collect()}
    assert np.allclose(own[0], np.full(3, -1 / math.sqrt(3)))
    quadrics = surface.plane_quadrics(*solid)
    at = solid[1].join(quadrics, "cell").select("cell", surface.quadric_error(*[solid[1][k] for k in "xyz"]).alias("e"), "min_face_area").collect()
    assert all(abs(r["e"]) < 1e-12 for r in at)
    assert {round(r["min_face_area"], 6) for r in at} == {0.5}


def test_dihedrals(solid):
    angles = sorted(round(r["angle"], 3) for r in surface.dihedrals(*solid).collect())
    assert angles == [90.0] * 3 + [round(math.degrees(math.acos(-1 / math.sqrt(3))), 3)] * 3


def test_degenerate_faces_have_no_normal(spark, solid):
    flat = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "c0 long, c1 long, c2 long")
    assert surface.vertex_normals(flat, solid[1]).count() == 3
    assert surface.vertex_normals(flat.limit(0), solid[1]).count() == 0


def test_multiset_diff(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a int"), spark.createDataFrame([(1,), (3,)], "a int")
    assert {r["a"]: r["surplus"] for r in surface.multiset_diff(left, right).collect()} == {1: 1, 2: 1, 3: -1, None: 1}


def test_ledger_says_when_it_does_not_balance(spark):
    rows = spark.createDataFrame([("retained",), ("dropped_island",), (None,)], "disposition string")
    found = lattice.ledger(rows).first()
    assert (found["input_points"], found["retained"], found["balanced"]) == (3, 1, False)


def las_bytes(points, minor=2, compressed=False, records=()):
    size = las.SMALLEST_HEADER[minor]
    chain = b"".join(struct.pack("<H16sHH32s", 0, user, number, len(body), b"") + body for user, number, body in records)
    head = bytearray(size)
    head[:4], head[24], head[25] = b"LASF", 1, minor
    struct.pack_into("<HIIBHI", head, 94, size, size + len(chain), len(records), 0x80 if compressed else 0, 20, 0 if minor == 4 else len(points))
    struct.pack_into("<12d", head, 131, 0.001, 0.001, 0.01, 10.0, 20.0, 30.0, 11.0, 9.0, 21.0, 19.0, 31.0, 29.0)
    if minor == 4:
        struct.pack_into("<Q", head, 247, len(points))
    return bytes(head) + chain + b"".join(struct.pack("<3i8x", *p) for p in points)


def test_las(spark, tmp_path):
    points = [(1, 2, 3), (-4, 5, -6)]
    (tmp_path / "a.bin").write_bytes(las_bytes(points))
    (tmp_path / "b.bin").write_bytes(las_bytes(points, 4, records=[(b"LASF_Projection", 2112, b"WKT")]))
    found = las.las_points(spark, str(tmp_path)).orderBy("path", "sample_id").collect()
    assert [(r["raw_x"], r["raw_y"], r["raw_z"]) for r in found] == points * 2
    assert np.allclose([found[1]["x"], found[1]["y"], found[1]["z"]], [9.996, 20.005, 29.94])
    (tmp_path / "c.las").write_bytes(b"nothing")
    (tmp_path / "d.las").write_bytes(las_bytes(points, records=[(b"laszip encoded", 22204, b"")]))
    (tmp_path / "e.las").write_bytes(b"ASTM-E57 and more")
    kinds = [r["kind"] for r in las.containers(spark, str(tmp_path)).orderBy("path").collect()]
    assert kinds == ["las", "las", "unknown", "laz", "e57"]
    heads = {r["path"][-5]: r for r in las.las_headers(spark, str(tmp_path)).collect()}
    assert heads["b"]["crs"] == ["wkt"] and heads["b"]["point_count"] == 2 and heads["b"]["minima"] == [9.0, 19.0, 29.0]
    assert heads["c"]["error"] == "no LAS signature" and heads["d"]["compressed"]
    findings = {(r["path"][-5], r["axis"]): r["finding"] for r in las.las_findings(las.las_headers(spark, str(tmp_path))).collect()}
    assert findings == {(k, "z"): "coarse scale" for k in "abd"}
    with pytest.raises(Exception, match="compressed"):
        las.las_points(spark, str(tmp_path / "d.las")).collect()


def _sheet(spark, n, height):
    points = [(r * n + c, float(c), float(r), height(r, c)) for r in range(n) for c in range(n)]
    faces = []
    for r in range(n - 1):
        for c in range(n - 1):
            a, b, d, e = r * n + c, r * n + c + 1, (r + 1) * n + c, (r + 1) * n + c + 1
            faces += [(c // (n // 2), a, d, b), (c // (n // 2), b, d, e)]
    return spark.createDataFrame(faces, "patch long, c0 long, c1 long, c2 long"), spark.createDataFrame(points, "cell long, x double, y double, z double")


def test_decimation_keeps_seams_and_bound(spark):
    faces, points = _sheet(spark, 12, lambda r, c: 0.02 * math.sin(r) * math.cos(c))
    found = decimate.decimate(faces, points, decimate.Settings(max_plane_deviation=0.05)).toPandas()
    assert 0 < len(found) < faces.count() and found["bound"].max() <= 0.05
    edges = lambda t: {tuple(r) for r in mesh.boundary_edges(t).collect()}
    after = spark.createDataFrame(found[["c0", "c1", "c2"]])
    assert edges(faces.drop("patch")) == edges(after)
    assert mesh.nonmanifold_edges(after).count() == 0
    locked = {r["cell"] for r in decimate.locked_cells(faces).collect()}
    before = {r["cell"]: (r["x"], r["y"], r["z"]) for r in points.collect()}
    for r in found.itertuples():
        for k in range(3):
            if getattr(r, f"c{k}") in locked:
                assert tuple(getattr(r, f"{a}{k}") for a in "xyz") == before[getattr(r, f"c{k}")]


def test_decimation_limits(spark):
    faces, points = _sheet(spark, 8, lambda r, c: 0.0)
    # Patches of more triangles than a task should hold are cut, and the cut stays.
    found = decimate.decimate(faces, points, max_triangles=20)
    assert 0 < found.count() < faces.count()
    assert decimate.seam_ledger(faces, found).first()["clean"]
    pieces = decimate.cut(faces, 20).groupBy("patch", "piece").count().collect()
    assert all(r["count"] <= 20 for r in pieces) and len(pieces) > 4
    assert [r["triangles"] for r in decimate.oversize(faces, 20).collect()] == [56, 42] or decimate.oversize(faces, 20).count() == 2
    assert decimate.decimate(faces.limit(0), points).count() == 0
    assert decimate.decimate(faces, points, decimate.Settings(target_triangles=1000)).count() == faces.count()


def _checked(points, faces, locked, settings):
    """A run of the collapser, with the rules that every step has to keep checked from outside."""
    own = decimate.Collapser(points, faces, locked, settings)
    own.run()
    after = own.faces
    ends = np.sort(np.concatenate([after[:, [0, 1]], after[:, [1, 2]], after[:, [2, 0]]]), axis=1)
    different, uses = np.unique(ends, axis=0, return_counts=True)
    assert uses.max() <= 2
    before = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    old = {tuple(e) for e in before.tolist()}
    both = different[locked[different].all(axis=1)]
    assert all(tuple(e) in old for e in both.tolist())
    assert (own.points[locked] == points[locked]).all()
    # Every vertex of before lies at most the bound from the planes that its keeper stands for.
    planes, _ = decimate.face_planes(points, faces)
    stands = own.survivors()
    for k in range(3):
        at = own.points[stands[faces[:, k]]]
        assert np.abs((planes[:, :3] * at).sum(axis=1) + planes[:, 3]).max() <= own.bound + 1e-9
    return own


def _bumpy(n, seed):
    rng = np.random.default_rng(seed)
    r, c = np.divmod(np.arange(n * n), n)
    points = np.stack([c, r, 0.3 * np.sin(r / 3) * np.cos(c / 4) + 0.01 * rng.normal(size=n * n)], axis=1).astype(float)
    a = (np.arange(n - 1)[:, None] * n + np.arange(n - 1)).ravel()
    faces = np.concatenate([np.stack([a, a + n, a + 1], axis=1), np.stack([a + 1, a + n, a + n + 1], axis=1)])
    rim = (r == 0) | (c == 0) | (r == n - 1) | (c == n - 1)
    return points, faces, rim


def test_collapses_keep_the_rules():
    points, faces, rim = _bumpy(24, 1)
    loose = _checked(points, faces, rim, decimate.Settings())
    tight = _checked(points, faces, rim, decimate.Settings(max_plane_deviation=0.02))
    assert len(loose.faces) < len(tight.faces) < len(faces) and tight.bound <= 0.02
    cheap = _checked(points, faces, rim, decimate.Settings(max_error=1e-3))
    assert len(cheap.faces) < len(faces)
    assert len(_checked(points, faces, rim, decimate.Settings(target_triangles=600)).faces) in (599, 600)
    assert len(_checked(points, faces, rim, decimate.Settings(reduction=2.0)).faces) in (len(faces) // 2, len(faces) // 2 - 1)
    flat = points * [1, 1, 0]
    assert _checked(flat, faces, rim, decimate.Settings(max_plane_deviation=1e-6)).bound < 1e-6
    steep = _checked(points, faces, rim, decimate.Settings(max_turn_deg=5.0))
    assert len(steep.faces) > len(loose.faces)
    nothing = decimate.Collapser(points, faces, np.ones(len(points), bool), decimate.Settings())
    nothing.run()
    assert len(nothing.faces) == len(faces) and nothing.rounds == 0


def test_rounds_do_not_depend_on_the_order_of_faces():
    points, faces, rim = _bumpy(15, 2)
    runs = []
    for seed in (0, 1):
        order = np.random.default_rng(seed).permutation(len(faces))
        own = decimate.Collapser(points, faces[order], rim, decimate.Settings(max_plane_deviation=0.05))
        own.run()
        runs.append({tuple(np.roll(f, -f.argmin())) for f in own.faces})
    assert runs[0] == runs[1]


def _union(sheets):
    """Sheets as patches of one collapser: points, faces, locked, and each vertex's patch."""
    starts = np.cumsum([0] + [len(points) for points, _, _ in sheets])
    faces = [faces + at for (_, faces, _), at in zip(sheets, starts, strict=False)]
    return np.concatenate([s[0] for s in sheets]), np.concatenate(faces), np.concatenate([s[2] for s in sheets]), np.repeat(np.arange(len(sheets)), np.diff(starts)), starts


def test_patches_together_are_those_alone():
    sheets = [_bumpy(9, 3), _bumpy(20, 4), _bumpy(3, 5), _bumpy(14, 6)]
    sheets[2][2][:] = True
    points, faces, locked, part, starts = _union(sheets)
    for settings in (decimate.Settings(max_plane_deviation=0.05), decimate.Settings(reduction=3.0), decimate.Settings(target_triangles=100), decimate.Settings()):
        own = decimate.Collapser(points, faces, locked, settings, part)
        own.run()
        for k, sheet in enumerate(sheets):
            alone = decimate.Collapser(*sheet, settings)
            alone.run()
            assert (own.faces[part[own.faces[:, 0]] == k] - starts[k]).tolist() == alone.faces.tolist()
            mine = slice(starts[k], starts[k + 1])
            assert (own.points[mine] == alone.points).all() and own.bounds[k] == alone.bound
            assert (own.survivors()[mine] - starts[k] == alone.survivors()).all()


def test_patches_in_any_batches():
    # Patches that end within batches, go on over several, or are null.
    rows = []
    for patch, (points, faces, rim) in zip((None, 3, 7), (_bumpy(6, 7), _bumpy(9, 8), _bumpy(4, 9)), strict=True):
        rows += [(patch, 0, False, c, None, None, *p, bool(locked)) for c, (p, locked) in enumerate(zip(points.tolist(), rim, strict=True))]
        rows += [(patch, 0, True, *f, None, None, None, False) for f in faces[::-1].tolist()]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3, pa.bool_()]
    names = ["patch", "piece", "face", "c0", "c1", "c2", "x", "y", "z", "locked"]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    found = []
    for size, rows_at_once in ((10_000, 40_000), (7, 10), (64, 150), (10_000, 30)):
        done = decimate._streamed(decimate.Settings(max_plane_deviation=0.05), True, rows_at_once)(iter(table.to_batches(size)))
        found.append(pa.Table.from_batches(done).to_pylist())
    order = lambda rows: sorted(rows, key=lambda r: [-1 if r[k] is None else r[k] for k in ("kind", "patch", "c0", "c1", "c2")])
    assert all(order(f) == order(found[0]) for f in found)
    assert {r["patch"] for r in found[0]} == {None, 3, 7} and 0 < sum(r["kind"] == "triangle" for r in found[0]) < 194


def test_vertices_with_several_places(spark):
    faces, points = _sheet(spark, 8, lambda r, c: 0.02 * math.sin(r) * math.cos(c))
    more = points.unionByName(points.where("cell % 3 = 0").withColumn("z", F.col("z") - 1)).unionByName(points.where("cell % 4 = 0").withColumn("z", F.lit(None).cast("double")))
    found = [sorted(map(tuple, decimate.decimate(faces, p, decimate.Settings(max_plane_deviation=0.05)).collect())) for p in (points, more)]
    assert found[0] == found[1]


def test_a_missing_vertex_raises(spark, solid):
    from stratagrid.sources import glb

    fewer = solid[1].where("cell <> 3")
    for job in (lambda: surface.vertex_normals(solid[0], fewer), lambda: decimate.decimate(solid[0].selectExpr("0L AS patch", "*"), fewer), lambda: glb.glb_tiles(solid[0].selectExpr("0L AS tile_id", "*"), fewer)):
        with pytest.raises(Exception, match="not there"):
            job().collect()


def test_representatives(spark):
    faces, points = _sheet(spark, 12, lambda r, c: 0.02 * math.sin(r) * math.cos(c))
    done = decimate.worked(faces, points, decimate.Settings(max_plane_deviation=0.05)).cache()
    stands = {r["cell"]: r["keeper"] for r in decimate.representatives_of(done).collect()}
    left = {v for r in decimate.triangles_of(done).collect() for v in (r["c0"], r["c1"], r["c2"])}
    assert set(stands) == set(range(144)) and set(stands.values()) == left


def test_dihedrals_across_tiles(spark, solid):
    angles = surface.dihedrals(*solid, owner=F.when(F.col("c1") == 2, 1).otherwise(0))
    assert angles.where("across").count() > 0 and angles.where("not across").count() > 0
    change = surface.dihedral_change(angles, angles).collect()
    assert all(r["mean_ratio"] == 1 and r["n_before"] == r["n_after"] for r in change)


def _brute_triangles(samples, cols, wrap, step, noise_floor):
    """Triangles quad by quad; samples is {(row, col): (rng, x, y, z)}."""
    reach, out = math.tan(math.radians(82.0)), []

    def good(*names):
        points = [q[n][1:] for n in names]
        longest = max(math.dist(points[a], points[b]) for a, b in ((0, 1), (0, 2), (1, 2)))
        area = 0.5 * float(np.linalg.norm(np.cross(np.subtract(points[1], points[0]), np.subtract(points[2], points[0]))))
        return longest > 0 and longest < max(noise_floor, max(q[n][0] for n in names) * step * reach) and 2 * area / longest**2 > 0.015

    for r in range(max(k[0] for k in samples) + 1):
        for c in range(cols if wrap else cols - 1):
            places = {"a": (r, c), "b": (r, (c + 1) % cols), "c": (r + 1, c), "d": (r + 1, (c + 1) % cols)}
            q = {n: samples[p] for n, p in places.items() if p in samples}
            if len(q) == 4:
                bc, ad = good(*"acb") and good(*"bcd"), good(*"acd") and good(*"adb")
                if bc and (not ad or math.dist(q["b"][1:], q["c"][1:]) <= math.dist(q["a"][1:], q["d"][1:])):
                    ways = ("acb", "bcd")
                else:
                    ways = ("acd", "adb") if ad else ()
            else:
                ways = [w for w in ("acb", "bcd", "acd", "adb") if set(w) == set(q) and good(*w)]
            out += [tuple(places[n][0] * cols + places[n][1] for n in w) for w in ways]
    return sorted(out)


def test_triangles_by_bands_of_rows(spark, monkeypatch):
    from stratagrid.operators import mesh

    monkeypatch.setattr(mesh, "BAND_CELLS", 45)
    rng = random.Random(3)
    samples = {(r, c): (rng.choice([2.0, 2.2, 9.0]), float(c), float(r), rng.random()) for r in range(23) for c in range(15) if rng.random() < 0.8}
    # Corners in one point make no triangle.
    for k in ((4, 4), (4, 5), (5, 4), (5, 5)):
        samples[k] = (2.0, 1.0, 1.0, 1.0)
    rows = [(*k, *v) for k, v in samples.items()]
    # Of samples in one place the one with the largest values counts; one without a place of its own counts nowhere.
    rows += [(*rows[0][:2], 1.0, 0.0, 0.0, 0.0), (None, 3, 2.0, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "row int, col int, rng double, x double, y double, z double").repartition(3)
    for wrap in (True, False):
        found = mesh.triangulate(table, 15, wrap, 0.4, noise_floor=1.0)
        assert sorted((r["c0"], r["c1"], r["c2"]) for r in found.collect()) == _brute_triangles(samples, 15, wrap, 0.4, 1.0)
        # A sample goes to one band or two, not to each of its quads.
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_seam_diff_in_one_aggregation(spark):
    before = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (4, 5)], "e0 long, e1 long")
    after = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "e0 long, e1 long")
    found = surface.seam_diff(before, after)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 2, "lost"), (4, 5, "lost"), (5, 6, "new")]

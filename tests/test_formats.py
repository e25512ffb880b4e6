"""Tiny files of each format, malformed ones, and round trips."""

import struct

from pointloom.operators import catalog, generators, joins
from pointloom.sources import formats as f


def put(tmp_path, text, mode="w"):
    p = tmp_path / "in.txt"
    with open(p, mode) as out:
        out.write(text)
    return str(p)


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("idx").select(*names).collect()]


def test_xyz(spark, tmp_path):
    t = f.read_xyz(spark, put(tmp_path, "2\n0.000000 0.000000 0.000000\n1.000000 2.000000 3.000000\n"))
    assert rows(t["points"], "idx", "x", "y", "z") == [(0, 0, 0, 0), (1, 1, 2, 3)]
    f.write_lines(f.xyz_lines(t["points"]), str(tmp_path / "out"))
    again = f.read_xyz(spark, str(tmp_path / "out"))
    assert rows(again["points"], "x", "y", "z") == [(0, 0, 0), (1, 2, 3)]
    assert rows(f.read_xyz(spark, put(tmp_path, "0\n"))["points"], "x") == []


def test_off(spark, tmp_path):
    t = f.read_off(spark, put(tmp_path, "OFF\n# comment\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2 255 255 255\n"))
    assert t["points"].count() == 3
    assert rows(t["faces"], "i0", "i1", "i2") == [(0, 1, 2)]
    lines = [r.value for r in f.off_lines(t["points"], t["faces"]).collect()]
    assert lines[:2] == ["OFF", "3 1 0"] and lines[-1] == "3 0 1 2 255 255 255"


def test_mesh(spark, tmp_path):
    t = f.read_mesh(spark, put(tmp_path, "1\n1.0, 2.0, 3.0\n0\n0\n1\n0, 0, 0\n"))
    assert rows(t["points"], "x", "y", "z") == [(1, 2, 3)]
    assert (t["normals"].count(), t["colors"].count(), t["faces"].count()) == (0, 0, 1)
    lines = [r.value for r in f.mesh_lines(t["points"], t["normals"], t["colors"], t["faces"]).collect()]
    assert lines == ["1", "1.000000, 2.000000, 3.000000", "0", "0", "1", "0, 0, 0"]


def test_obj(spark, tmp_path):
    t = f.read_obj(spark, put(tmp_path, "v 0 0 0\nv 1 0 0 1 0 0\nv 0 1 0\nvt 0 1\nvn 0 0 1\nf 1/1/1 2//1 3\nf 1 2 3 1\ng x\n"))
    assert t["points"].count() == 3 and rows(t["colors"], "r", "g", "b") == [(1, 0, 0)]
    assert rows(t["faces"], "i0", "i1", "i2") == [(1, 2, 3)] and t["uvs"].count() == 1 and t["normals"].count() == 1
    assert [r.value for r in f.obj_lines(t["points"], t["faces"]).collect()] == ["v 0 0 0", "v 1 0 0", "v 0 1 0", "f 1 2 3"]


PLY = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 255 0 0\n1 2 3 0 128 255\n3 0 1 1\n"


def test_ply(spark, tmp_path):
    t = f.read_ply(spark, put(tmp_path, PLY))
    assert rows(t["points"], "x", "y", "z") == [(0, 0, 0), (1, 2, 3)]
    assert rows(t["colors"], "r", "g", "b") == [(1, 0, 0), (0, 128 / 255, 1)] and rows(t["faces"], "i0", "i1", "i2") == [(0, 1, 1)]
    f.write_lines(f.ply_lines(t["points"], t["faces"], colors=t["colors"]), str(tmp_path / "ply"))
    again = f.read_ply(spark, str(tmp_path / "ply"))
    assert rows(again["points"], "x", "y", "z") == [(0, 0, 0), (1, 2, 3)] and rows(again["faces"], "at") == [([0, 1, 1],)]
    assert f.read_ply(spark, put(tmp_path, PLY.replace("ply\n", "x\n", 1)))["points"].count() == 0
    broken = f.read_ply(spark, put(tmp_path, PLY.replace("1 2 3 0 128 255\n3 0 1 1\n", "1 two\n")))["points"]
    assert rows(broken, "x", "_corrupt_record")[1] == (None, "1 two")


def test_alp(spark, tmp_path):
    raw = struct.pack("<II18f", 2, 36, *range(18))
    assert len(raw) == 80 and raw[:8].hex() == "0200000024000000"
    t = f.read_alp(spark, put(tmp_path, raw, "wb"))
    assert rows(t, "idx", "x", "b") == [(0, 0, 8), (1, 9, 17)]
    assert bytes(f.alp_bytes(t).first().content) == raw
    assert f.read_alp(spark, put(tmp_path, raw[:50], "wb")).count() == 1


def test_cache(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert f.cached(spark, str(tmp_path / "cache"), make).count() == 3
    assert len(made) == 1


def test_generators(spark):
    assert generators.box(spark).count() == 36
    assert generators.sphere(spark).count() == 49 and generators.sphere_indices(spark).count() == 216
    assert generators.sphere(spark, around=8, down=4).count() == 45
    assert tuple(generators.grid(spark).where("idx = 10203").first())[1:4] == (3, 2, 1)
    assert {abs(x) for r in generators.box(spark).collect() for x in (r.x, r.y, r.z)} == {0.5}


def test_labels(spark):
    p = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)], "idx long, r double, g double, b double")
    labels = spark.createDataFrame([(0, 4294967295), (1, 0)], "idx long, label long")
    got = [tuple(r)[1:] for r in joins.with_label_colours(p, labels).orderBy("idx").collect()]
    assert got[0] == (1, 1, 1) and got[1][0] == 0
    kept = [tuple(r)[1:] for r in joins.with_label_colours(p, labels, keep_last=True).orderBy("idx").collect()]
    assert kept == [(1, 1, 1)] * 2


def test_registry(spark):
    edges = catalog.type_edges(spark)
    assert edges.count() == 19 and catalog.closure(edges).count() == 40
    rows_ = spark.createDataFrame([(0, "Shader", "s"), (1, "CameraBase", "c")], "seq long, type string, name string")
    assert catalog.create(rows_, "Transform", "t").orderBy("seq").collect()[-1].seq == 2

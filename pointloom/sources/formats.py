"""Point and mesh files: readers and writers of XYZ, OFF, CustomMesh, OBJ, ascii PLY and binary ALP.

A text file is read whole into one row (so up to 2 GB) and parsed by one task, as the formats' counted
sections can't be split without reading what comes before; many files are read side by side. A reader
returns a dictionary of DataFrames, each with `path` and `idx`; a record that doesn't parse has nulls,
and its line in `_corrupt_record`.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import six_digits

_ROW = "path string, section string, idx long, v array<double>, _corrupt_record string"


def _numbers(tokens: list[str], n: int) -> list[float] | None:
    try:
        return [float(t) for t in tokens[:n]] if len(tokens) >= n else None
    except ValueError:
        return None


def _counted(lines: Iterator[str], section: str, count: int, width: int, skip: int = 0, split=str.split):
    for i in range(count):
        line = next(lines, None)
        if line is None:
            return
        v = _numbers(split(line)[skip:], width)
        yield section, i, v, None if v else line


def _live(text: str) -> Iterator[str]:
    return (x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#"))


def _count(line: str | None) -> int:
    try:
        return max(0, int((line or "0").split()[0]))
    except (ValueError, IndexError):
        return 0


def _xyz(text: str):
    lines = _live(text)
    yield from _counted(lines, "point", _count(next(lines, None)), 3)


def _off(text: str):
    lines = _live(text)
    if not next(lines, "").strip().startswith("OFF"):
        return
    head = (next(lines, "") + " 0 0").split()
    yield from _counted(lines, "point", _count(head[0]), 3)
    for i in range(_count(head[1])):
        line = next(lines, None)
        if line is None:
            return
        t = line.split()
        v = _numbers(t[1:], 3) if t[0] == "3" else None
        yield "face", i, v, None if v else line
        colour = _numbers(t[4:], 3) if v else None
        if colour:
            yield "color", i, [c / 255.0 for c in colour], None


def _mesh(text: str):
    lines = _live(text)
    for section in ("point", "normal", "color", "face"):
        yield from _counted(lines, section, _count(next(lines, None)), 3, split=lambda x: x.replace(",", " ").split())


def _ply(text: str):
    lines = iter(text.splitlines())
    if next(lines, "").strip() != "ply":
        return
    elements: list[tuple[str, int, list[str]]] = []
    for line in lines:
        t = line.split()
        if not t or t[0] in ("comment", "obj_info"):
            continue
        if t[0] == "format" and t[1:2] != ["ascii"]:
            return
        if t[0] == "element":
            elements.append((t[1], _count(t[2]), []))
        elif t[0] == "property" and elements:
            elements[-1][2].append("list" if t[1] == "list" else t[-1])
        elif t[0] == "end_header":
            break
    for name, count, properties in elements:
        for i in range(count):
            line = next(lines, None)
            if line is None:
                return
            t = line.split()
            if "list" in properties:
                v = _numbers(t[1:], _count(t[0])) if t else None
                yield name, i, v, None if v else line
                continue
            v = _numbers(t, len(properties))
            if not v:
                yield "point", i, None, line
                continue
            at = dict(zip(properties, v, strict=False))
            if name != "vertex":
                yield name, i, v, None
                continue
            for section, names, divide in (("point", "x y z", 1), ("normal", "nx ny nz", 1), ("uv", "u v", 1), ("color", "red green blue", 255.0)):
                names = names.split()
                if all(k in at for k in names):
                    own = [at[k] / divide for k in names]
                    alpha = at.get("alpha", at.get("a"))
                    yield section, i, own + ([alpha / 255.0] if section == "color" and alpha is not None else []), None


def _parsed(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = [(p, *r) for p, text in zip(f["path"], f["value"], strict=True) for r in parse(text)]
            yield pd.DataFrame(rows, columns=["path", "section", "idx", "v", "_corrupt_record"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, _ROW)


def _section(rows: DataFrame, section: str, names: str, kind: str = "double") -> DataFrame:
    return rows.where(F.col("section") == section).select("path", "idx", *[F.get("v", F.lit(i)).cast(kind).alias(n) for i, n in enumerate(names.split())], "_corrupt_record")


def _tables(rows: DataFrame) -> dict[str, DataFrame]:
    faces = rows.where("section = 'face'").select("path", "idx", F.transform("v", lambda x: x.cast("long")).alias("at"), "_corrupt_record")
    return {
        "points": _section(rows, "point", "x y z"),
        "normals": _section(rows, "normal", "nx ny nz"),
        "colors": _section(rows, "color", "r g b a"),
        "faces": faces.select("path", "idx", *[F.get("at", F.lit(i)).alias(f"i{i}") for i in range(3)], "at", "_corrupt_record"),
    }


def read_xyz(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _tables(_parsed(spark, path, _xyz))


def read_off(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _tables(_parsed(spark, path, _off))


def read_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _tables(_parsed(spark, path, _mesh))


def read_ply(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An edge element's rows are in "edges". `at` of a face has all its vertices."""
    rows = _parsed(spark, path, _ply)
    return _tables(rows) | {"edges": _section(rows, "edge", "v1 v2", "long"), "uvs": _section(rows, "uv", "u v")}


def _obj(text: str):
    n = {"v": 0, "vt": 0, "vn": 0, "f": 0}
    for line in text.splitlines():
        t = line.split()
        if not t or t[0] not in n:
            continue
        tag = t[0]
        if tag == "f":
            if len(t) != 4:
                continue
            v = _numbers([x.split("/")[0] for x in t[1:]], 3)
        else:
            v = _numbers(t[1:], 2 if tag == "vt" else 3)
        i = n[tag]
        n[tag] += 1
        yield {"v": "point", "vt": "uv", "vn": "normal", "f": "face"}[tag], i, v, None if v else line
        if tag == "v" and v and len(t) >= 7 and (c := _numbers(t[4:], 3)):
            yield "color", i, c, None


def read_obj(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Faces of three vertices, with the indices as written (from 1)."""
    rows = _parsed(spark, path, _obj)
    return _tables(rows) | {"uvs": _section(rows, "uv", "u v")}


FIELDS = "x y z nx ny nz r g b".split()
#: A record's fields and numpy types; the default is 36 bytes of floats.
RECORD = tuple((n, "<f4") for n in FIELDS)
HEADER_BYTES = 8


def record_bytes(record=RECORD) -> int:
    import numpy as np

    return np.dtype(list(record)).itemsize


def _record_schema(record) -> str:
    return ", ".join(f"`{n}` " + ("double" if "f" in kind else "long") for n, kind in record)


def read_alp(spark: SparkSession, path: str, record=RECORD) -> DataFrame:
    """Records after a header of two unsigned 32-bit numbers, their count and size; an incomplete rest is dropped, and
    a file whose records have another size gives none. Integer fields are longs, others doubles."""
    import numpy as np

    kind = np.dtype(list(record))

    def run(frames):
        for f in frames:
            for p, raw in zip(f["path"], f["content"], strict=True):
                count, size = struct.unpack_from("<II", raw) if len(raw) >= HEADER_BYTES else (0, 0)
                n = min(count, (len(raw) - HEADER_BYTES) // kind.itemsize) if size == kind.itemsize else 0
                values = np.frombuffer(raw, kind, n, HEADER_BYTES) if n > 0 else np.zeros(0, kind)
                for at in range(0, len(values), 1 << 16):
                    part = values[at : at + (1 << 16)]
                    out = {"path": p, "idx": np.arange(at, at + len(part))} | {name: part[name].astype(float if "f" in k else np.int64) for name, k in record}
                    yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, idx long, " + _record_schema(record))


def alp_parts(points: DataFrame, record=RECORD) -> DataFrame:
    """(part, content): the file's bytes in pieces by range of idx, the header first; concatenated by part they are the file."""
    import numpy as np

    kind, names = np.dtype(list(record)), [n for n, _ in record]

    def run(batches):
        from pyspark import TaskContext

        for k, f in enumerate(batches):
            rows = np.zeros(len(f), kind)
            for n in names:
                rows[n] = f[n].to_numpy()
            yield pd.DataFrame({"part": [(TaskContext.get().partitionId() << 32) + k], "content": [rows.tobytes()]})

    body = points.select("idx", *names).repartitionByRange("idx").sortWithinPartitions("idx").mapInPandas(run, "part long, content binary")
    pack = F.udf(lambda n: struct.pack("<II", n, kind.itemsize), "binary")  # of one row
    return points.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("part"), pack("n").alias("content")).unionByName(body)


def alp_bytes(points: DataFrame, record=RECORD) -> DataFrame:
    """One row, a small file's whole content."""

    def run(frames):
        rows = pd.concat(list(frames)).sort_values("part")
        yield pd.DataFrame({"content": [b"".join(rows["content"])]})

    return alp_parts(points, record).coalesce(1).mapInPandas(run, "content binary")


def byte_total(points: DataFrame, record=RECORD) -> DataFrame:
    """The bytes that the file of these points has, as a long."""
    return points.agg((F.count("*") * record_bytes(record) + HEADER_BYTES).cast("long").alias("bytes"))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, chunks) -> int:
    """The chunks of bytes one after the other as one file, in any store that Spark writes; the bytes written."""
    p, store = _path(spark, path)
    out, n = store.create(p, True), 0
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
            n += len(chunk)
    finally:
        out.close()
    return n


def write_alp(points: DataFrame, path: str, record=RECORD) -> int:
    """One file, its parts fetched and written one at a time; the bytes written."""
    parts = alp_parts(points, record).orderBy("part")
    return write_bytes(points.sparkSession, path, (r.content for r in parts.toLocalIterator()))


def read_bytes(spark: SparkSession, path: str, start: int = 0, n: int | None = None) -> DataFrame:
    """(path, length, content): n bytes of each file from start on, to its end for None."""
    files = spark.read.format("binaryFile").load(path)
    size = F.lit(n) if n is not None else F.col("length").cast("int")
    return files.select("path", "length", F.substr("content", F.lit(start + 1), size).alias("content"))


def use_alpha(colors: DataFrame, *by: str) -> DataFrame:
    """Whether any colour has an alpha."""
    return colors.groupBy(*by).agg(F.bool_or(F.col("a").isNotNull()).alias("use_alpha"))


def _lines(parts: list[tuple[int, DataFrame]], heads: list[tuple[int, object]], spark: SparkSession) -> DataFrame:
    """(value) in order of section and idx. heads: literal or one-row lines."""
    out = None
    for k, df in [(k, d.select(F.lit(k).alias("s"), "idx", "value")) for k, d in parts] + [(k, h.select(F.lit(k).alias("s"), F.lit(-1).cast("long").alias("idx"), "value") if isinstance(h, DataFrame) else spark.range(1).select(F.lit(k).alias("s"), F.lit(-1).cast("long").alias("idx"), F.lit(h).alias("value"))) for k, h in heads]:
        out = df if out is None else out.unionByName(df)
    return out.orderBy("s", "idx").select("value")


def _joined(df: DataFrame, names: str, f, sep: str = " ", head: str = "") -> DataFrame:
    return df.select("idx", F.concat(F.lit(head), F.concat_ws(sep, *[f(F.col(n)) for n in names.split()])).alias("value"))


_fixed = lambda c: F.format_string("%.6f", c)
_whole = lambda c: c.cast("string")
_byte = lambda c: F.least(F.greatest(F.floor(c * 255), F.lit(0)), F.lit(255)).cast("string")


def _total(df: DataFrame | None, before: str = "", after: str = "") -> DataFrame:
    return df.agg(F.concat(F.lit(before), F.count("*").cast("string"), F.lit(after)).alias("value"))


def xyz_lines(points: DataFrame) -> DataFrame:
    return _lines([(1, _joined(points, "x y z", _fixed))], [(0, _total(points))], points.sparkSession)


def off_lines(points: DataFrame, faces: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """A face's colour is that of its first vertex, white without one."""
    rows = faces.join(colors.select(F.col("idx").alias("i0"), "r", "g", "b"), "i0", "left") if colors is not None else faces.withColumns({c: F.lit(1.0) for c in "rgb"})
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(1.0)) for c in "rgb"})
    shown = rows.select("idx", F.concat_ws(" ", F.lit("3"), *[F.col(f"i{k}").cast("string") for k in range(3)], *[_byte(F.col(c)) for c in "rgb"]).alias("value"))
    head = _total(points).crossJoin(_total(faces).withColumnRenamed("value", "f")).select(F.concat_ws(" ", "value", "f", F.lit("0")).alias("value"))  # one row each
    return _lines([(2, _joined(points, "x y z", _fixed)), (3, shown)], [(0, "OFF"), (1, head)], points.sparkSession)


def mesh_lines(points: DataFrame, normals: DataFrame, colors: DataFrame, faces: DataFrame) -> DataFrame:
    parts, heads = [], []
    for k, (df, names, f) in enumerate(((points, "x y z", _fixed), (normals, "nx ny nz", _fixed), (colors, "r g b", _fixed), (faces, "i0 i1 i2", _whole))):
        parts.append((2 * k + 1, _joined(df, names, f, ", ")))
        heads.append((2 * k, _total(df)))
    return _lines(parts, heads, points.sparkSession)


def obj_lines(points: DataFrame, faces: DataFrame, normals: DataFrame | None = None, uvs: DataFrame | None = None, colors: DataFrame | None = None) -> DataFrame:
    """v (with r g b where given), each followed by its vn; then vt; then f, indices as given (from 1)."""
    v = points if colors is None else points.join(colors.select("idx", "r", "g", "b"), "idx", "left")
    names = "x y z" + (" r g b" if colors is not None else "")
    parts = [(0, _joined(v, names, six_digits, head="v ").withColumn("idx", F.col("idx") * 2))]
    if normals is not None:
        parts.append((0, _joined(normals, "nx ny nz", six_digits, head="vn ").withColumn("idx", F.col("idx") * 2 + 1)))
    if uvs is not None:
        parts.append((1, _joined(uvs, "u v", six_digits, head="vt ")))
    mark = {(False, False): "{0}", (True, False): "{0}//{0}", (False, True): "{0}/{0}", (True, True): "{0}/{0}/{0}"}[normals is not None, uvs is not None]
    parts.append((2, _joined(faces, "i0 i1 i2", lambda c: F.format_string(mark.replace("{0}", "%1$d"), c), head="f ")))
    return _lines(parts, [], points.sparkSession)


def ply_lines(points: DataFrame, faces: DataFrame | None = None, normals: DataFrame | None = None, colors: DataFrame | None = None, edges: DataFrame | None = None, uvs: DataFrame | None = None) -> DataFrame:
    """Header by the attributes present, vertices, edges, faces. Colours with a column a are written with alpha; what
    a vertex lacks is white, or 0."""
    spark, v = points.sparkSession, points
    values = [six_digits(F.col(c)) for c in "xyz"]
    properties = [f"property float {c}" for c in "xyz"]

    def attribute(rows: DataFrame, names: list[str], written: list[str], missing: float, show, kind: str) -> None:
        nonlocal v
        v = v.join(rows.select("idx", *names), "idx", "left")
        values.extend(show(F.coalesce(F.col(c), F.lit(missing))) for c in names)
        properties.extend(f"property {kind} {c}" for c in written)

    if normals is not None:
        attribute(normals, ["nx", "ny", "nz"], ["nx", "ny", "nz"], 0.0, six_digits, "float")
    if colors is not None:
        n = 4 if "a" in colors.columns else 3
        attribute(colors, list("rgba")[:n], ["red", "green", "blue", "alpha"][:n], 1.0, _byte, "uchar")
    if uvs is not None:
        attribute(uvs, ["u", "v"], ["u", "v"], 0.0, six_digits, "float")
    heads: list[str | DataFrame] = ["ply", "format ascii 1.0", _total(points, "element vertex "), *properties]
    parts = [v.select("idx", F.concat_ws(" ", *values).alias("value"))]
    if edges is not None:
        heads += [_total(edges, "element edge "), "property int vertex1", "property int vertex2"]
        parts.append(_joined(edges, "v1 v2", _whole))
    if faces is not None:
        heads += [_total(faces, "element face "), "property list uchar int vertex_indices"]
        parts.append(_joined(faces, "i0 i1 i2", _whole, head="3 "))
    heads.append("end_header")
    return _lines([(len(heads) + k, p) for k, p in enumerate(parts)], list(enumerate(heads)), spark)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file in the folder path: the formats are a single sequence of lines. The sort goes on in parallel;
    only the writer takes the sorted lines one after the other."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="pointloom-files-")
    return f"{named.rstrip('/')}/files-{uuid.uuid4().hex}"


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made first if it isn't there."""
    p, store = _path(spark, f"{path}/_SUCCESS")
    if not store.exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

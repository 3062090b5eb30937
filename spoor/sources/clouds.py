"""Point cloud files as a Spark data source: ``pointcloud`` reads and writes PCD and PLY, one partition a file.

Files are decoded with NumPy from bytes that Spark itself has read (``binaryFile``), so any store that Spark knows will
do; the data source form serves paths that the workers can open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.scalars import file_time

POINTS = "path string, frame_ts double, x double, y double, z double, vx double, vy double, vz double"

_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def unpacked(packed: bytes, size: int) -> bytes:
    """LZF: a byte under 32 begins that many and one literals, any other a copy of what came before."""
    out, at = bytearray(), 0
    while at < len(packed):
        head = packed[at]
        at += 1
        if head < 32:
            out += packed[at : at + head + 1]
            at += head + 1
            continue
        length = head >> 5
        if length == 7:
            length += packed[at]
            at += 1
        back = ((head & 31) << 8 | packed[at]) + 1
        at += 1
        size_left = length + 2
        while size_left > 0:  # a copy may overlap what it makes: by pieces of what is there
            piece = out[-back:][:size_left] if back >= size_left else bytes(out[-back:])
            out += piece[:size_left]
            size_left -= len(piece)
    if len(out) != size:
        raise ValueError("a compressed PCD body has another size than it says")
    return bytes(out)


def parse_pcd(data: bytes) -> tuple[np.ndarray, tuple[float, float, float] | None]:
    """Points (n, 3) and the viewpoint's place; ASCII, binary and compressed bodies."""
    head, end = {}, 0
    while True:
        stop = data.index(b"\n", end)
        line = data[end:stop].decode("ascii", "replace").split()
        end = stop + 1
        if line and not line[0].startswith("#"):
            head[line[0].upper()] = line[1:]
            if line[0].upper() == "DATA":
                break
    sizes, kinds = head.get("SIZE", []), head.get("TYPE", [])
    times = [int(c) for c in head.get("COUNT", ["1"] * len(sizes))]
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    fields, view = head["FIELDS"], None
    try:
        view = tuple(float(v) for v in head["VIEWPOINT"][:3]) if len(head.get("VIEWPOINT", [])) >= 3 else None
    except ValueError:
        view = None
    if head["DATA"][0] == "ascii":
        rows = np.array([ln.split() for ln in data[end:].decode("ascii", "replace").splitlines() if ln.strip()], dtype=object)
        start = np.cumsum([0, *times])
        at = [int(start[fields.index(a)]) for a in "xyz"]
        return (rows[:, at].astype(float) if len(rows) else np.empty((0, 3))), view
    if head["DATA"][0] == "binary_compressed":
        small, size = np.frombuffer(data, "<u4", 2, end)
        raw, body, at = unpacked(data[end + 8 : end + 8 + int(small)], int(size)), {}, 0
        for f, k, s, c in zip(fields, kinds, sizes, times, strict=True):  # a field after the other
            body[f] = np.frombuffer(raw, f"<{k.lower()}{s}", n * c, at).reshape(n, c)
            at += n * c * int(s)
        return np.stack([body[a][:, 0] for a in "xyz"], 1).astype(float), view
    if head["DATA"][0] != "binary":
        raise ValueError(f"PCD body {head['DATA'][0]} is not supported")
    kind = np.dtype([(f"{f}{i}", f"<{k.lower()}{s}", (c,)) for i, (f, k, s, c) in enumerate(zip(fields, kinds, sizes, times, strict=True))])
    body = np.frombuffer(data, kind, n, end)
    return np.stack([body[f"{a}{fields.index(a)}"][:, 0] for a in "xyz"], 1).astype(float), view


def parse_ply(data: bytes) -> np.ndarray:
    """The vertices (n, 3) of an ASCII or little-endian PLY whose vertices come first."""
    end = data.index(b"end_header")
    head = data[:end].decode("ascii").split("\n")
    body = data.index(b"\n", end) + 1
    kind = next(h.split()[1] for h in head if h.startswith("format"))
    n, props, inside = 0, [], False
    for h in head:
        p = h.split()
        if p[:1] == ["element"]:
            inside = p[1] == "vertex"
            n = int(p[2]) if inside else n
        elif p[:1] == ["property"] and inside:
            props.append((p[2], _PLY_TYPES[p[1]]))
    names = [p[0] for p in props]
    if kind == "ascii":
        rows = np.array([ln.split() for ln in data[body:].decode("ascii").splitlines()[:n]], dtype=object)
        return rows[:, [names.index(a) for a in "xyz"]].astype(float) if n else np.empty((0, 3))
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[kind]
    rows = np.frombuffer(data, np.dtype([(a, order + t) for a, t in props]), n, body)
    return np.stack([rows[a] for a in "xyz"], 1).astype(float)


def decode(path: str, data: bytes) -> tuple[np.ndarray, tuple[float, float, float] | None]:
    return parse_pcd(data) if path.lower().endswith(".pcd") else (parse_ply(data), None)


def encode(path: str, points: np.ndarray) -> bytes:
    """Little-endian doubles, as PCD or PLY by the path's suffix."""
    n, body = len(points), np.ascontiguousarray(points, "<f8").tobytes()
    if path.lower().endswith(".pcd"):
        return f"VERSION .7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n".encode() + body
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty double x\nproperty double y\nproperty double z\nend_header\n".encode() + body


def read_clouds(spark: SparkSession, folder: str, glob: str = "*.pcd") -> DataFrame:
    """``POINTS`` of all files that match. An empty file gives no row; ``list_frames`` names it, and raises where no file is."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", file_time(F.col("path")).alias("frame_ts"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ts, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                p, view = decode(path, content)
                for lo in range(0, len(p), 100_000):
                    q = p[lo : lo + 100_000]
                    fixed = [pa.array([v] * len(q), pa.float64()) for v in (view or (None,) * 3)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(q)), pa.array([ts] * len(q), pa.float64()), *(pa.array(q[:, i]) for i in range(3)), *fixed], names=[c.split()[0] for c in POINTS.split(", ")])

    return files.mapInArrow(run, POINTS)


def list_frames(spark: SparkSession, folder: str, glob: str = "*.pcd") -> DataFrame:
    """``path, frame_ts`` by file name alone; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", file_time(F.col("path")).alias("frame_ts"))
    if found.isEmpty():
        raise FileNotFoundError(f"no {glob} in {folder}")
    return found


class PointCloudSource(DataSource):
    """``spark.read.format("pointcloud").load(folder)`` and ``df.write.format("pointcloud").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return "path string, x double, y double, z double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.glob = options["path"], options.get("glob", "*.p*")

    def partitions(self):
        from pathlib import Path

        root = Path(self.folder.removeprefix("file://"))
        return [_File(str(p)) for p in ([root] if root.is_file() else sorted(root.glob(self.glob)))]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            points, _ = decode(partition.path, f.read())
        for lo in range(0, len(points), 100_000):
            p = points[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(p)), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(3))], names=["path", "x", "y", "z"])


class _Writer(DataSourceWriter):
    """One file a task, named by the task, so a task that runs again writes the same file."""

    def __init__(self, options):
        self.folder, self.kind = options["path"].removeprefix("file://"), options.get("kind", "ply")

    def write(self, rows):
        import os

        from pyspark import TaskContext

        points = np.array([(r["x"], r["y"], r["z"]) for r in rows], float).reshape(-1, 3)
        if len(points):
            os.makedirs(self.folder, exist_ok=True)
            name = f"{self.folder}/part-{TaskContext.get().partitionId():05d}.{self.kind}"
            with open(f"{name}.tmp", "wb") as f:
                f.write(encode(name, points))
            os.replace(f"{name}.tmp", name)
        return WriterCommitMessage()


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """``face_id, v0, v1, v2`` of a Wavefront OBJ file; polygons of any size are cut into fans.

    Corners are numbered from 1, or from the last vertex so far where negative. Vertices are numbered by partitions of
    lines: a count a partition, then places within it.
    """
    from pyspark.sql import Window as W

    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.spark_partition_id().alias("p"), part.alias("part"))
    lines = lines.where(F.get("part", F.lit(0)).isin("v", "f")).select("n", "p", "part", (F.get("part", F.lit(0)) == "v").alias("vertex"))
    starts = lines.groupBy("p").agg(F.count_if("vertex").alias("c"))
    # a row a partition
    starts = starts.select(F.col("p").alias("_p"), F.coalesce(F.sum("c").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    seen = F.count_if("vertex").over(W.partitionBy("p").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.join(starts, F.col("p") == F.col("_p")).withColumn("i", F.col("start") + seen)
    v = lines.where("vertex").select("i", F.array(*[F.get("part", F.lit(k)).cast("double") for k in (1, 2, 3)]).alias("xyz"))
    corner = lambda c: F.split(c, "/")[0].cast("long")
    f = lines.where("NOT vertex").select("n", F.transform(F.slice("part", F.lit(2), F.size("part")), lambda c: F.when(corner(c) < 0, F.col("i") + 1 + corner(c)).otherwise(corner(c))).alias("c"))
    fans = f.select("n", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k")).select(F.struct("n", "k").alias("face_id"), F.get("c", F.lit(0)).alias("i0"), F.get("c", F.col("k")).alias("i1"), F.get("c", F.col("k") + 1).alias("i2"))
    for k in range(3):
        fans = fans.join(v.select(F.col("i").alias(f"i{k}"), F.col("xyz").alias(f"v{k}")), f"i{k}")
    return fans.select("face_id", "v0", "v1", "v2")


def _ply_head(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str, str | None]]]], int]:
    """Format, elements (name, number, properties: name, type, and the type of its count for a list), and where the body begins."""
    end = data.index(b"end_header")
    kind, elements = "", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        p = line.split()
        if p[:1] == ["format"]:
            kind = p[1]
        elif p[:1] == ["element"]:
            elements.append((p[1], int(p[2]), []))
        elif p[:1] == ["property"]:
            elements[-1][2].append((p[4], _PLY_TYPES[p[3]], _PLY_TYPES[p[2]]) if p[1] == "list" else (p[2], _PLY_TYPES[p[1]], None))
    return kind, elements, data.index(b"\n", end) + 1


def _ply_rows(data: bytes, at: int, n: int, properties, order: str) -> tuple[dict[str, np.ndarray | list], int]:
    """Columns of one binary element and where it ends. Lists of one length throughout are read at once, others row by row."""

    def record(lengths: dict[str, int]) -> np.dtype:
        return np.dtype([f for name, kind, count in properties for f in (((f"{name}#", order + count), (name, order + kind, (lengths[name],))) if count else ((name, order + kind),))])

    def lengths_at(place: int) -> dict[str, int]:
        out = {}
        for name, kind, count in properties:
            if count:
                out[name] = int(np.frombuffer(data, order + count, 1, place)[0])
                place += np.dtype(count).itemsize + out[name] * np.dtype(kind).itemsize
            else:
                place += np.dtype(kind).itemsize
        return out

    if not n:
        return {name: np.empty(0) for name, _, _ in properties}, at
    lengths = lengths_at(at)
    kind = record(lengths)
    if at + n * kind.itemsize <= len(data):
        rows = np.frombuffer(data, kind, n, at)
        if all((rows[f"{name}#"] == k).all() for name, k in lengths.items()):
            return {name: rows[name] for name, _, _ in properties}, at + n * kind.itemsize
    columns: dict[str, list] = {name: [] for name, _, _ in properties}
    for _ in range(n):
        kind = record(lengths_at(at))
        row = np.frombuffer(data, kind, 1, at)
        for name in columns:
            columns[name].append(row[name][0])
        at += kind.itemsize
    return columns, at


def parse_ply_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n, 3) and triangles (m, 3) of a PLY file, ASCII or binary; polygons of any size are cut into fans."""
    kind, elements, at = _ply_head(data)
    vertices, polygons = np.empty((0, 3)), []
    words = iter(data[at:].split()) if kind == "ascii" else None
    order = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": "<"}[kind]
    for name, n, properties in elements:
        if words is not None:
            columns = {p: [] for p, _, _ in properties}
            for _ in range(n):
                for p, _, count in properties:
                    columns[p].append(np.array([next(words) for _ in range(int(next(words)))], float).astype(np.int64) if count else float(next(words)))
        else:
            columns, at = _ply_rows(data, at, n, properties, order)
        if name == "vertex":
            vertices = np.stack([np.asarray(columns[a], float) for a in "xyz"], 1)
        elif name == "face":
            polygons = columns.get("vertex_indices", columns.get("vertex_index", []))
    if isinstance(polygons, np.ndarray) and polygons.ndim == 2:
        corners = polygons.astype(np.int64)
        fans = [np.stack([corners[:, 0], corners[:, k], corners[:, k + 1]], 1) for k in range(1, corners.shape[1] - 1)]
        triangles = np.stack(fans, 1).reshape(-1, 3) if fans else np.empty((0, 3), np.int64)
    else:
        triangles = np.array([(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)], np.int64).reshape(-1, 3)
    if len(triangles) and not (0 <= triangles.min() and triangles.max() < len(vertices)):
        raise ValueError("a face names a vertex that is not there")
    return vertices, triangles


def read_meshes(spark: SparkSession, path: str, glob: str = "*.ply") -> DataFrame:
    """``face_id, v0, v1, v2`` of all PLY meshes that match, taken together as one; ``face_id`` is the file and the face's number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vertices, triangles = parse_ply_mesh(content)
                for lo in range(0, len(triangles), 100_000):
                    t = triangles[lo : lo + 100_000]
                    at = pa.StructArray.from_arrays([pa.array([name] * len(t)), pa.array(np.arange(lo, lo + len(t)))], names=["path", "n"])
                    corners = [pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(t) + 1, 3, dtype=np.int32)), pa.array(vertices[t[:, k]].ravel())) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([at, *corners], names=["face_id", "v0", "v1", "v2"])

    return files.mapInArrow(run, "face_id struct<path: string, n: long>, v0 array<double>, v1 array<double>, v2 array<double>")


def is_cloud(path: str) -> bool:
    return re.search(r"\.(pcd|ply)$", path, re.IGNORECASE) is not None

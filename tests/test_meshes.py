"""PLY meshes with lists of any length, and copies in compressed clouds."""

import struct

import numpy as np
import pytest

from spoor.plans.mesh import sample_surface
from spoor.sources import clouds

V = [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.0, 2.0, 0.0), (0.0, 2.0, 0.0), (1.0, 1.0, 3.0)]


def ply(faces, kind, extra=True):
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(kind)
    head = ["ply", f"format {kind} 1.0", "comment made by hand", f"element vertex {len(V)}", "property double x", "property float q", "property double y", "property double z"]
    head += ["element note 2", "property list uchar short marks", "property uchar one"] if extra else []
    head += [f"element face {len(faces)}", "property uchar shade", "property list uchar int vertex_indices", "end_header\n"]
    out = "\n".join(head).encode()
    notes = [((5, 6, 7), 1), ((), 2)] if extra else []
    if order is None:
        lines = [f"{x} 0.5 {y} {z}" for x, y, z in V] + [" ".join(map(str, (len(m), *m, o))) for m, o in notes] + [" ".join(map(str, (9, len(f), *f))) for f in faces]
        return out + "\n".join(lines).encode() + b"\n"
    for x, y, z in V:
        out += struct.pack(order + "dfdd", x, 0.5, y, z)
    for m, o in notes:
        out += struct.pack(f"{order}B{len(m)}hB", len(m), *m, o)
    for f in faces:
        out += struct.pack(f"{order}BB{len(f)}i", 9, len(f), *f)
    return out


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
@pytest.mark.parametrize("faces", [[(0, 1, 2), (0, 2, 3)], [(0, 1, 2, 3), (0, 1, 4)], [(0, 1, 2, 3), (3, 2, 1, 0)], [(0, 1, 2, 3, 4)], [], [(0, 1), (2, 3, 4)]])
def test_faces_of_any_length(kind, faces):
    vertices, triangles = clouds.parse_ply_mesh(ply(faces, kind))
    assert vertices.tolist() == [list(v) for v in V]
    assert triangles.tolist() == [[f[0], f[k], f[k + 1]] for f in faces for k in range(1, len(f) - 1)]


def test_a_face_beyond_the_vertices():
    with pytest.raises(ValueError, match="not there"):
        clouds.parse_ply_mesh(ply([(0, 1, 5)], "ascii"))


def test_several_meshes_are_one(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply([(0, 1, 2, 3)], "binary_little_endian"))
    (tmp_path / "b.ply").write_bytes(ply([(0, 1, 4), (1, 2, 4)], "ascii", extra=False))
    (tmp_path / "c.ply").write_bytes(ply([], "ascii"))
    faces = clouds.read_meshes(spark, f"{tmp_path}")
    assert faces.count() == 4 and faces.select("face_id").distinct().count() == 4
    area = sum(np.linalg.norm(np.cross(np.subtract(r.v1, r.v0), np.subtract(r.v2, r.v0))) / 2 for r in faces.collect())
    assert np.isclose(area, 4 + 2 * np.sqrt(10))
    assert sample_surface(faces, 60, even=False).count() in range(57, 64)


def test_overlapping_copies():
    # a literal of two bytes, then copies of 9 and of 40 bytes that overlap what they make
    packed = bytes([1, 65, 66, 7 << 5, 0, 1, 7 << 5, 31, 0])
    want = bytearray(b"AB")
    for length, back in ((9, 2), (40, 1)):
        for _ in range(length):
            want.append(want[-back])
    assert clouds.unpacked(packed, len(want)) == bytes(want)

"""Tiled images against the kernels for whole ones, and connected groups."""

import numpy as np

from platen.operators import graph, masks, raster, tiles
from platen.sources import codecs

SIDE = 16
PLAN = "path string, obj_idx int, bounds struct<min_x:double,min_y:double,max_x:double,max_y:double>, theta double, turns int"


def files_of(spark, pictures):
    rows = [(p, bytearray(codecs.encode(im, "png")), "png") for p, im in pictures.items()]
    return spark.createDataFrame([*rows, ("broken", bytearray(b"x"), "png"), ("none", None, "tiff")], "path string, content binary, format string")


def test_rendered_tiles_are_those_of_whole_images(spark):
    rng, pictures, planned = np.random.default_rng(3), {}, []
    for i, (h, w, c) in enumerate([(5, 70, 1), (61, 33, 3), (40, 40, 4), (16, 32, 3), (1, 1, 1)]):
        pictures[f"p{i}"] = rng.integers(0, 65536 if i == 1 else 256, (h, w, c)).astype(np.uint16 if i == 1 else np.uint8)
        for k in range(4):
            theta = float(np.float32(rng.uniform(-1.5, 1.5))) if k else 0.0
            bounds = tuple(float(v + rng.uniform(-3, 3)) for v in tiles.theta_window(w, h, theta))
            planned.append((f"p{i}", k, (900.0, 900.0, 920.0, 911.0) if k == 3 else bounds, theta, k))  # the last lies outside
    cut = tiles.cut_files(files_of(spark, pictures), SIDE)
    crops = spark.createDataFrame([*planned, ("p0", 9, None, 0.0, 0), ("broken", 0, (0.0, 0.0, 1.0, 1.0), 0.0, 0)], PLAN)
    found = {(r.path, r.obj_idx): codecs.decode(bytes(r.content), "tiff") for r in tiles.tiff_files(tiles.render(cut, crops, SIDE), SIDE).collect()}
    assert len(found) == len(planned)
    for path, k, bounds, theta, turns in planned:
        assert np.array_equal(found[path, k], raster.rgb_output(pictures[path], bounds, theta, turns)), (path, k)
    errors = {r.path: r.error for r in cut.where("error is not null").collect()}
    assert set(errors) == {"broken", "none"}


def spiral(side):
    """One arm that crosses many tiles, some of them again and again."""
    m = np.zeros((side, side), bool)
    for ring in range(0, side // 2, 2):
        m[ring, max(0, ring - 2) : side - ring] = m[ring : side - ring, side - 1 - ring] = m[side - 1 - ring, ring : side - ring] = m[ring + 2 : side - ring, ring] = True
    return m


def test_labels_across_tiles(spark):
    rng = np.random.default_rng(7)
    own = {f"m{i}": rng.random((int(h), int(w))) < share for i, (h, w, share) in enumerate([(50, 70, 0.5), (33, 17, 0.35), (64, 64, 0.6), (80, 16, 0.45)])}
    own |= {"spiral": spiral(80), "empty": np.zeros((20, 20), bool), "full": np.ones((40, 40), bool), "crossing": np.add.outer(np.arange(40), np.arange(40)) % 31 == 0}
    cut = tiles.cut_files(files_of(spark, {p: (m * 255).astype(np.uint8)[:, :, None] for p, m in own.items()}), SIDE)
    found: dict[str, list] = {p: [] for p in own}
    for r in tiles.objects(tiles.label_tiles(cut, 128, SIDE)).orderBy("path", "obj_idx").collect():
        found[r.path].append((r.area, r.label, r.min_x, r.min_y, r.max_x, r.max_y))
    for p, m in own.items():
        assert found[p] == [(o.area, int(o.runs.y[0]) * m.shape[1] + int(o.runs.left[0]), o.min_x, o.min_y, o.max_x, o.max_y) for o in masks.connected_objects(m)], p
    assert len(found["spiral"]) == len(found["full"]) == 1 and not found["empty"]


def test_connected_groups(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    assert {r.node: r.root for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()} == {x: top(x) for x in list(up)}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_rows_share_batches():
    import pyarrow as pa

    from platen.sources import batches

    schema = pa.schema([("path", pa.string()), ("data", pa.binary())])
    rows = [{"path": str(i), "data": b"x" * 27} for i in range(1200)] + [{"path": "large", "data": bytes(batches.BYTES)}, {"path": "last", "data": None}]
    made = list(batches.batched(iter(rows), schema))
    assert [b.num_rows for b in made] == [512, 512, 177, 1] and [r for b in made for r in b.to_pylist()] == rows

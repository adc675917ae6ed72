"""Operators on hand-drawn grids, and against brute force."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridframe import operators as o
from gridframe import sources
from gridframe.core import Recipe, drawn, grid, replay
from gridframe.functions.equation import metric, parse
from gridframe.plans.loop import loop


def pairs(g, layer, name="distance"):
    return {(a, b): round(v, 6) if v is not None else None for a, b, v in g.pairs[(layer, name)].collect()}


def test_patches_and_measures(spark):
    g = o.componentise(drawn(spark, "10000/00000/00110/00000"), add="p")
    g = o.perimeter(o.area(g, layer="p"), layer="p")
    assert sorted(map(tuple, g.table("p").select("gid", "area", "perimeter").collect())) == [(1, 1.0, 2.0), (2, 2.0, 6.0)]
    g = o.class_distance(g, "straight", layer="p")
    assert pairs(g, "p")[(1.0, 2.0)] == round(math.sqrt(8), 6) and pairs(g, "p")[(1.0, 1.0)] == math.inf
    g = metric(g, "max(area.all[complete.all])", "largest", layer="p")
    assert g.globals["p"]["largest"] == 2
    g = metric(metric(g, "area.self / sum(area.all)", "share", layer="p"), "min(distance.others)", "enn", layer="p")
    assert sorted((round(r["share"], 3), round(r["enn"], 3)) for r in g.table("p").collect()) == [(0.333, 2.828), (0.667, 2.828)]


def test_adjacency_and_contrast(spark):
    g = o.adjacency(drawn(spark, "1122/1122"))
    assert pairs(g, "values", "adjacency") == {(1, 1): 8, (2, 2): 8, (1, 2): 2, (2, 1): 2}
    g = o.dissimilarity(g, {(1, 1): 0, (2, 2): 0, (1, 2): 0.5, (2, 1): 0.5})
    assert [r["dissimilarity"] for r in g.table().collect()] == [1, 1]
    wide = drawn(spark, "1122/1122", (0, 4, 0, 6))
    assert [r["perimeter"] for r in o.perimeter(wide).table().collect()] == [6, 6]
    with pytest.raises(ValueError):
        o.dissimilarity(wide, {(1, 2): 1, (2, 1): 1})


def test_cheapest_path_over_a_barrier(spark):
    g = o.pad(drawn(spark, "11322/11322/99999/11322/11322"), 1, value=9)
    g = o.componentise(o.mask_filter(g, "values = 1", add="one"), layer="one", add="p")
    g = o.replace_values(g, [1, 2, 3, 9], [1, 1, 1, 10], layer="values", add="k")
    assert pairs(o.class_distance(g, cost="k", unit="cells", layer="p"), "p")[(1.0, 2.0)] == 11
    assert pairs(o.class_distance(g, "straight", cost="k", unit="cells", layer="p"), "p")[(1.0, 2.0)] == 12
    h = o.replace_values(g, [10], [None], layer="k")
    assert pairs(o.class_distance(h, cost="k", unit="cells", layer="p"), "p")[(1.0, 2.0)] is None


def test_zones(spark):
    g = o.componentise(drawn(spark, "11000/11000/00000/00010/00000"), add="z")
    assert sorted(x for x in o.summarise(g, "z", "n", layer="values", add="n").pull("n") if x) == [1, 4, 4, 4, 4]
    block = o.summarise(drawn(spark, "00000/01110/01110/01110/00000"), "values", "max", neighbours=True, add="m")
    assert max(x for x in block.pull("m") if x is not None) == 0
    assert o.fill(drawn(spark, "11100/10100/11100/00001")).pull()[6] == 1
    assert o.centroid(drawn(spark, "111/111/111")).pull()[4] == 1


def test_match_fails_on_nulls_and_borders(spark):
    k = o.structure(custom=[[0, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert [i for i, x in enumerate(o.match(drawn(spark, "10000/00000/00100/00000/00000"), k).pull()) if x] == [12]
    assert not any(o.match(drawn(spark, "10000/00000/00100/000.0/00000"), k).pull())


SHAPES = {
    ("disc", 3, 3): "111/111/111", ("disc", 5, 5): "01110/11111/11111/11111/01110", ("disc", 7, 7): "0011100/0111110/1111111/1111111/1111111/0111110/0011100", ("disc", 5, 3): "01110/11111/01110",
    ("diamond", 3, 3): "010/111/010", ("diamond", 5, 5): "00100/01110/11111/01110/00100", ("square", 5, 5): "11111/11111/11111/11111/11111", ("rectangle", 5, 3): "11111/11111/11111",
    ("cross", 5, 5): "00100/00100/11111/00100/00100", ("diamond", 7, 3): "0011100/1111111/0011100", ("diamond", 3, 7): "010/010/111/111/111/010/010",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_structures(shape):
    kind, width, height = shape
    got = {(i + height // 2, j + width // 2) for i, j, _ in o.structure(kind, width, height)}
    assert "/".join("".join("01"[(i, j) in got] for j in range(width)) for i in range(height)) == SHAPES[shape]


@pytest.mark.parametrize("kind", ["disc", "diamond", "box"])
def test_structures_cover_half_of_their_cells(kind):
    norm = {"disc": math.hypot, "diamond": lambda a, b: a + b, "box": max}[kind]
    for width in range(1, 14, 2):
        for height in range(1, 14, 2):
            most, want = max(width, height), set()
            for i in range(-(height // 2), height // 2 + 1):
                for j in range(-(width // 2), width // 2 + 1):
                    near, far = (norm(*(most / n * abs(d + s * 0.5 * ((d > 0) - (d < 0))) for d, n in ((j, width), (i, height)))) for s in (-1, 1))
                    share = 1 if near == far else (most / 2 - near) / (far - near)
                    if near < most / 2 and share >= 0.5:
                        want.add((i, j))
            assert {(i, j) for i, j, _ in o.structure(kind, width, height)} == want
    for bad in ((4, 3), (3, 4), (0, 1)):
        with pytest.raises(ValueError):
            o.structure(kind, *bad)


def test_structures_say_how_they_are_used(spark):
    g = drawn(spark, "0000/0100/0000")
    corner = o.structure(custom=[[0, None, None], [None, 1, None], [None, None, None]], rotate=True, background=0)
    assert o.match(g, corner).pull() == o.match(g, list(corner), rotate=True, background=0).pull()
    k = o.structure("square", 3, background=-1)
    assert o.morph(drawn(spark, "1.2"), k, merge="max").pull() == [1, -1, 2]


@pytest.mark.parametrize("method", ["euclidean", "manhattan", "chessboard"])
def test_distances_against_brute_force(spark, method):
    rnd = random.Random(method)
    m = [[float(rnd.random() < 0.12) for _ in range(11)] for _ in range(9)]
    m[0][0] = 1.0
    away = {"euclidean": math.hypot, "manhattan": lambda a, b: abs(a) + abs(b), "chessboard": lambda a, b: max(abs(a), abs(b))}[method]
    got = o.distance(grid(spark, (0, 11, 0, 9), 1, m), method=method, add="d").pull("d")
    for i in range(9):
        for j in range(11):
            assert got[i * 11 + j] == pytest.approx(min(away(i - y, j - x) for y in range(9) for x in range(11) if m[y][x]))


def test_no_source_gives_a_distance_beyond_the_map(spark):
    assert o.distance(drawn(spark, "00/00/00")).pull() == [5, 5, 6, 6, 7, 7]


def test_skeletons_keep_their_topology(spark):
    ring = drawn(spark, "0000000/0111110/0111110/0110110/0111110/0111110/0000000")
    for method in ("zhangSuen", "homotopic"):
        thin = o.skeletonise(ring, background=0, method=method)
        assert o.fill(thin).pull()[3 * 7 + 3] == 1 and sum(thin.pull()) < sum(ring.pull())


def test_recipes_and_loops(spark):
    r = o.dilate(o.mask_filter(Recipe(), "values = 1"))
    g = drawn(spark, "1000/0000")
    assert sum(replay(g, r).pull()) == 3
    assert replay(g, replay(g, r)).pull() == replay(g, r).pull()
    assert sum(loop(g, o.dilate(), stable=True).pull()) == 8
    with pytest.raises(ValueError):
        replay(g, Recipe())
    with pytest.raises(ValueError):
        loop(g, o.dilate())


def test_plans_stay_small(spark):
    g = drawn(spark, "00000/00100/00000")
    for _ in range(8):
        g = o.dilate(g)
    plan = g.cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert g.pull() == [1] * 15
    h, sizes = drawn(spark, "100.200/0300.11"), []
    for _ in range(8):
        h = o.blend(o.interpolate(o.fill(o.mask_filter(o.permute(h, "revert"), "values > 1", add="m"), layer="m"), layer="values", add="s"), ["values", "s"], "max")
        h = o.morph(h, o.structure("disc", 3), merge="mean")
        sizes.append(h.cells._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
    assert max(sizes) <= 16 and sizes[-1] <= max(sizes[:4])


def test_loops_end(spark):
    g = drawn(spark, "100000/000000")
    one = loop(g, o.dilate(), until="sum(values) >= 6")
    assert sum(one.pull()) == 7 and one.provenance[-1]["activity"] == {"iterations": 3}
    assert loop(g, o.dilate(), until="sum(values) >= 6", times=2).provenance[-1]["activity"] == {"iterations": 2}
    still = loop(g, o.dilate(), stable=True)
    assert sum(still.pull()) == 12 and still.provenance[-1]["activity"]["iterations"] == 7 and "iterations: 7" in repr(still)
    for bad in ({"until": "values > 1"}, {"times": 0}, {}):
        with pytest.raises(ValueError):
            loop(g, o.dilate(), **bad)


def test_layers_may_have_any_name(spark):
    for name in ("v", "w", "b", "t", "_v", "_in", "_own0", "_merged", "k", "a b", "gid"):
        g = grid(spark, (0, 3, 0, 2), 1, {name: [[0, 1, 0], [0, 0, 0]], "other": [[5, 6, 7], [8, 9, None]]})
        out = o.erode(o.dilate(g, layer=name), layer=name) if name != "a b" else o.morph(g, o.structure("cross", 3), layer="other")
        assert out.pull("other")[:5] == [5, 6, 7, 8, 9] if name != "a b" else out.pull("other")[0] == 8
        assert sum(out.pull(name)) in (1, 2, 4)


def cheapest(cost, seeds):
    import heapq

    best, heap = {}, [(0.0, s) for s in seeds]
    while heap:
        d, (i, j) = heapq.heappop(heap)
        if (i, j) in best:
            continue
        best[i, j] = d
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                y, x = i + a, j + b
                if (a or b) and 0 <= y < len(cost) and 0 <= x < len(cost[0]) and cost[y][x] is not None and (y, x) not in best:
                    heapq.heappush(heap, (d + (cost[i][j] + cost[y][x]) / 2 * (math.sqrt(2) if a and b else 1), (y, x)))
    return best


@pytest.mark.parametrize("side", [4, 7, 256])
def test_cost_distances_over_tiles(spark, monkeypatch, side):
    import importlib

    module = importlib.import_module("gridframe.operators.distance")
    monkeypatch.setattr(module, "TILE", side)
    rnd = random.Random(side)
    cost = [[None if rnd.random() < 0.2 else float(rnd.choice([1, 1, 2, 9])) for _ in range(23)] for _ in range(17)]
    cost[0][0] = cost[16][22] = 1.0
    seeds = [[float((r, c) in ((0, 0), (16, 22))) for c in range(23)] for r in range(17)]
    got = o.distance(grid(spark, (0, 23, 0, 17), 1, {"seed": seeds, "k": cost}), cost="k", layer="seed", add="d").pull("d")
    want = cheapest(cost, [(0, 0), (16, 22)])
    assert any(want.get((r, c)) is None and cost[r][c] for r in range(17) for c in range(23)) or side
    for r in range(17):
        for c in range(23):
            assert got[r * 23 + c] == (pytest.approx(want[r, c]) if (r, c) in want else None)


@pytest.mark.parametrize(("side", "few"), [(4, 100_000), (4, 0), (5, 3), (256, 0)])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_patches_over_tiles(spark, monkeypatch, side, few, connectivity):
    from gridframe.operators import zonal

    monkeypatch.setattr(zonal, "TILE", side)
    monkeypatch.setattr(zonal, "FEW_EDGES", few)
    rnd = random.Random(side)
    text = "/".join("".join(rnd.choice("0112.") for _ in range(19)) for _ in range(13))
    m = [[None if x in "0." else x for x in row] for row in text.split("/")]
    want, n = {}, 0
    for r in range(13):
        for c in range(19):
            if m[r][c] and (r, c) not in want:
                n += 1
                todo = [(r, c)]
                while todo:
                    at = todo.pop()
                    if at in want:
                        continue
                    want[at] = n
                    todo += [(at[0] + i, at[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (connectivity == 8 or not (i and j)) and 0 <= at[0] + i < 13 and 0 <= at[1] + j < 19 and m[at[0] + i][at[1] + j] == m[r][c]]
    assert o.componentise(drawn(spark, text), connectivity).pull() == [want.get((r, c)) for r in range(13) for c in range(19)]


def test_nearest_of_many_centres(spark):
    from gridframe.core import blank
    from gridframe.operators import zonal

    rnd = random.Random(9)
    centres = [(float(i), rnd.random() * 6, rnd.random() * 40) for i in range(1, 60)] + [(60.0, 38.5, 39.25), (61.0, 38.5, 39.25)]
    g = grid(spark, (0, 41, 0, 43), 1)
    table = spark.createDataFrame(centres, "id double, y double, x double")
    got = zonal.nearest_of_many(blank(spark, g.meta), table, g.meta)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, zonal.nearest(blank(spark, g.meta), centres).collect())) and got.count() == 41 * 43


def test_homotopic_skeletons_keep_parts_and_holes(spark):
    # a thick ring and a bar: between the anchors a path is left, the ring keeps its hole, a part without anchors a cell
    text = "000000000000/011111000000/011111011111/011011011111/011111011111/011111000000/000000000000"
    g = drawn(spark, text)
    thin = o.skeletonise(g, background=0, method="homotopic")
    assert o.componentise(thin, 8).cells.agg(F.max("values")).first()[0] == 2 and o.fill(thin).pull()[3 * 12 + 3] == 1
    again = o.skeletonise(o.rotate(g, 180), background=0, method="homotopic")
    assert o.rotate(again, 180).pull() == thin.pull()  # whatever the order
    ends = drawn(spark, "/".join("000000010001" if i == 3 else "0" * 12 for i in range(7)))
    kept = o.skeletonise(o.add_layers(g, ends, rename={"values": "ends"}), background=0, anchor="ends", method="homotopic")
    assert kept.pull("values")[3 * 12 + 7 : 3 * 12 + 12] == [1] * 5 and sum(kept.pull("values")) == sum(thin.pull()) + 4


def test_pattern_classes_of_drawn_shapes(spark):
    from gridframe.plans.patterns import pattern_classes

    rows = [[0] * 24 for _ in range(13)]
    fill = lambda r0, r1, c0, c1, v=1: [rows[r].__setitem__(c, v) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
    fill(2, 8, 2, 8), fill(5, 5, 5, 5, 0), fill(2, 8, 14, 20), fill(5, 5, 9, 13), fill(10, 11, 2, 3), fill(3, 3, 21, 22)
    got = pattern_classes(drawn(spark, "/".join("".join(map(str, r)) for r in rows))).pull("pattern")
    at = lambda r, c: got[r * 24 + c]
    core = {(r, c) for r in range(3, 8) for c in range(3, 8) if max(abs(r - 5), abs(c - 5)) == 2} | {(r, c) for r in range(3, 8) for c in range(15, 20)}
    assert {(r, c) for r in range(13) for c in range(24) if at(r, c) == 1} == core
    assert {(r, c) for r in range(13) for c in range(24) if at(r, c) == 4} == {(10, 2), (10, 3), (11, 2), (11, 3)}
    assert all(at(r, c) == 3 for r in (4, 5, 6) for c in (4, 5, 6) if (r, c) != (5, 5)) and at(5, 5) == 0
    assert all(at(5, c) == 5 for c in range(9, 14)) and at(3, 22) == 7 and at(2, 2) == at(8, 20) == 6
    assert all((x == 0) == (rows[k // 24][k % 24] == 0) for k, x in enumerate(got))


def test_class_tables_and_histories(spark):
    g = o.categorise(drawn(spark, "0123/4567"), breaks=[2, 4.5], add="cls")
    assert sorted(map(tuple, g.table("cls").select("gid", "val").collect())) == [(1, "0-2"), (2, "2-4.5"), (3, "4.5-7")]
    assert sorted(map(tuple, o.categorise(g, shares=[0.25, 0.75], add="s").table("s").collect())) == [(1, "0-1"), (2, "2-7")]
    g = metric(o.area(g, layer="cls"), "max(area.all)", "most", layer="cls")
    assert g.table("cls", overall=True).first()["most"] == 3 and "most: 3" in g.show("cls") and "4.5-7" in g.show("cls") and ".. and 2 more" in g.show("cls", n=1)
    assert [h["fn"] for h in g.provenance] == ["categorise", "area", "metric"] and g.provenance[0]["made"] == ["cls"]
    long = o.replace_values(g, list(range(1, 4001)), [0.0], layer="values")
    assert long.pull("values") == [0] * 8 and any("sha256" in str(a) for a in long.provenance[-1]["args"])
    with pytest.raises(ValueError):
        g.table("values", overall=True)
    with pytest.raises(ValueError, match="another name"):
        o.categorise(g, n=2, layer="values", add="c")


def test_functions_of_ones_own(spark):
    from gridframe.core import register

    g = drawn(spark, "0123/4567")
    register("double", lambda v: 2 * v)
    register("spread", lambda v: F.max(v) - F.min(v), aggregate=True)
    g = o.mask_filter(g, "values > 3", add="z")
    assert o.blend(g, ["values", "z"], lambda a, b: a * 10 + b, add="out").pull("out")[4] == 41
    assert o.summarise(g, "z", lambda v: F.count_distinct(v), layer="values", add="out").pull("out")[4:] == [4, 4, 4, 4]
    t = metric(metric(g, "double(spread(values.self))", "a", layer="z"), "prod(values.others)", "b", layer="z").table("z")
    assert sorted((r["gid"], r["a"], round(r["b"])) for r in t.collect()) == [(0, 6, 840), (1, 6, 0)]
    with pytest.raises(ValueError):
        metric(g, "spread(values.others)", "c", layer="z")


def test_well_known_text(spark):
    from gridframe.operators.raster import from_wkt

    known = lambda *texts: from_wkt(spark.createDataFrame(list(enumerate(texts, 1)), "id int, wkt string"))
    shapes, kind = known("POLYGON((1 1, 5 1, 5 5, 1 5, 1 1),(2 2, 4 2, 4 4, 2 4, 2 2))", "MultiPolygon (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))")
    assert kind == "polygon" and shapes.count() == 16
    out = o.rasterise(grid(spark, (0, 6, 0, 6), 1), shapes, kind).pull()
    assert out.count(1) == 12 and out.count(2) == 2
    points, kind = known("POINT(1.5 2.5)", "MULTIPOINT((3.5 2.5), (4.5 0.5))", "SRID=4326;POINT Z (0.5 0.5 9)")
    assert kind == "point" and sorted(map(tuple, points.select("id", "x", "y").collect())) == [(1, 1.5, 2.5), (2, 3.5, 2.5), (2, 4.5, 0.5), (3, 0.5, 0.5)]
    lines, kind = known("LINESTRING(0.5 0.5, 5.5 0.5)", "MULTILINESTRING((0 1, 2 1), (3 3, 4 4, 5 5))")
    assert kind == "line" and [r["n"] for r in lines.groupBy("id", "part").agg(F.count("x").alias("n")).orderBy("id", "part").collect()] == [2, 2, 3]
    for bad in (("POINT(0 0)", "LINESTRING(0 0, 1 1)"), ("CIRCLE(1)",)):
        with pytest.raises(ValueError):
            known(*bad)


def test_ascii_grids(spark, tmp_path):
    text = "ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2 -9\n 4 5 6 \n"
    (tmp_path / "a.asc").write_text(text)
    g = sources.read_ascii(spark, f"file://{tmp_path}/a.asc", group=True)
    assert g.pull() == [1, 2, None, 4, 5, 6] and (g.meta.xmin, g.meta.xmax, g.meta.ymin, g.meta.ymax) == (10, 25, 20, 30)
    assert sorted(r["val"] for r in g.table().collect()) == ["1", "2", "4", "5", "6"]
    (tmp_path / "b.asc").write_bytes(text.replace("NODATA_value -9\n", "").replace("\n", "\r\n").encode())
    assert sources.read_ascii(spark, f"file://{tmp_path}/b.asc").pull() == [1, 2, -9, 4, 5, 6]


def test_measures_of_an_older_grid_are_warned_of(spark):
    g = o.area(drawn(spark, "11/22"))
    for change in (lambda: o.crop(g, (0, 1, 0, 1)), lambda: o.pad(g, 1), lambda: o.resize(g, 2)):
        with pytest.warns(UserWarning, match="measures"):
            change()


def test_recoding(spark):
    g = drawn(spark, "0123")
    assert o.categorise(g, breaks=[1, 2, 3, 8]).pull() == [1, 2, 3, 4]
    assert o.categorise(g, shares=[0.5, 0.5]).pull() == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        o.categorise(drawn(spark, "0113"), shares=[0.5, 0.5])
    assert o.replace_values(drawn(spark, "12."), [1, 2, None], [2, 1, 5]).pull() == [2, 1, 5]
    assert o.permute(drawn(spark, "135"), "revert").pull() == [5, 3, 1]
    assert o.offset(drawn(spark, "123"), "%%", -2).pull() == [-1, 0, -1]


def test_geometry(spark):
    g = drawn(spark, "123/456")
    assert o.rotate(g, 90).pull() == [4, 1, 5, 2, 6, 3] and o.transpose(g).pull() == [1, 4, 2, 5, 3, 6]
    assert o.rotate(o.rotate(g, 90), 270).pull() == g.pull()
    assert o.crop(g, (0.5, 2, 1.2, 2)).pull() == [1, 2]
    p = o.pad(g, 2, value=0)
    assert (p.meta.ncol, p.meta.nrow, p.meta.xmin, p.meta.ymax) == (7, 6, -2, 4)
    assert o.pad(p, -2).pull() == g.pull() and o.pad(g, 0) is g
    assert o.resize(g, 2).pull()[:6] == [1, 1, 2, 2, 3, 3]


def test_polygons_lines_and_points(spark):
    ring = lambda part, a, b: [(1, part, k, x, y) for k, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    shape = spark.createDataFrame(ring(0, 1.0, 5.0) + ring(1, 2.0, 4.0), "id int, part int, seq int, x double, y double")
    empty = grid(spark, (0, 6, 0, 6), 1)
    assert sum(x or 0 for x in o.rasterise(empty, shape, "polygon").pull()) == 12
    line = spark.createDataFrame([(2, 0, 0, 0.5, 0.5), (2, 0, 1, 5.5, 0.5)], "id int, part int, seq int, x double, y double")
    assert o.rasterise(empty, line, "line").pull()[30:] == [2] * 6
    assert o.rasterise(empty, line, "point").pull()[30:] == [2, None, None, None, None, 2]


def test_generators(spark):
    g = grid(spark, (0, 24, 0, 16), 1)
    for out, name in ((o.noise(g, "perlin"), "noise"), (o.noise(g, "simplex"), "noise"), (o.texture(g, "ridged"), "texture"), (o.texture(g, "diamondSquare"), "texture"), (o.gradient(g, "circle", size=3), "gradient")):
        low, high = out.cells.agg(F.min(name), F.max(name)).first()
        assert (low, high) == (0, 1)
    assert o.noise(g, seed=3).pull() == o.noise(grid(spark, (0, 24, 0, 16), 1), seed=3).pull()
    assert abs(sum(o.cluster(g, p=0.3).pull()) / 384 - 0.3) < 0.1
    assert o.tessellation(g, n=5).cells.select("tiles").distinct().count() == 5
    assert None not in o.cluster(g, "randomCluster").pull()


def test_equations():
    assert parse("-2^2") == ("neg", ("op", "^", ("num", 2.0), ("num", 2.0)))
    for bad in ("area", "area.self +", "(area.self", "area.one"):
        with pytest.raises(ValueError):
            parse(bad)


def test_round_trip(spark, tmp_path):
    g = o.area(drawn(spark, "112/331"))
    sources.write(g, f"file://{tmp_path}/g")
    back = sources.read(spark, f"file://{tmp_path}/g")
    assert back.pull() == g.pull() and back.meta == g.meta and back.table().count() == 3
    both = o.adjacency(o.mask_filter(g, "values = 1", add="one"), layer="values")
    sources.write(both, f"file://{tmp_path}/h")
    back = sources.read(spark, f"file://{tmp_path}/h")
    assert back.pull("one") == [1, 1, 0, 0, 0, 1] and back.pairs[("values", "adjacency")].count() == 9 and back.binary == {"one"}
    assert [h["fn"] for h in back.provenance] == ["area", "mask_filter", "adjacency"] and "2. mask_filter" in repr(back)
    with pytest.raises(ValueError):
        replay(g, back)


@pytest.mark.parametrize("routing", ["straight", "cheapest"])
def test_class_distances_of_all_classes_against_brute_force(spark, routing):
    from gridframe import queries_coverage  # noqa: F401
    from gridframe.queries import QUERIES, supply

    cells = [(x["r"], x["c"], x["n"]) for x in supply(spark, "/root/testdata/sf0.001").cells.collect() if x["n"]]
    want = {(n, n): math.inf for _, _, n in cells}
    for r, c, n in cells:
        for y, x, m in cells:
            i, j = abs(r - y), abs(c - x)
            d = math.hypot(i, j) if routing == "straight" else max(i, j) + (math.sqrt(2) - 1) * min(i, j)
            if n != m and d < want.get((n, m), math.inf):
                want[(n, m)] = d
    got = {(x["a"], x["b"]): x["value"] for x in QUERIES[f"class_distance_{routing}"](spark, "/root/testdata/sf0.001").collect()}
    assert len(want) > 9 and got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("routing", ["straight", "cheapest"])
def test_class_distances_of_scattered_classes(spark, routing):
    rnd = random.Random(4)
    text = "/".join("".join(rnd.choice("00000000000000012345" if i > 9 else "0000000006") for _ in range(23)) for i in range(17))
    cells = [(r, c, float(v)) for r, line in enumerate(text.split("/")) for c, v in enumerate(line) if v != "0"]
    got = pairs(o.class_distance(drawn(spark, text), routing, unit="cells", layer="values"), "values")
    far = lambda i, j: math.hypot(i, j) if routing == "straight" else max(i, j) + (math.sqrt(2) - 1) * min(i, j)
    ids = sorted({v for _, _, v in cells})
    want = {(a, b): math.inf if a == b else min(far(abs(r - y), abs(c - x)) for r, c, v in cells if v == a for y, x, w in cells if w == b) for a in ids for b in ids}
    assert got == pytest.approx(want, abs=1e-6)


def test_distances_look_down_long_columns_once(spark):
    """A frame that ends with the column costs the square of its length: none may be in the plan, and a long column has to come out right."""
    from gridframe.core import GridFrame, GridMeta, blank
    from gridframe.operators.distance import to_sources

    meta = GridMeta(0, 2, 0, 60_000, 2, 60_000)
    g = GridFrame(meta, blank(spark, meta))
    d = to_sources(g, spark.createDataFrame([(10, 0), (59_000, 1)], "r int, c int"), "manhattan")
    assert "unboundedfollowing" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
    want = sum(min(abs(r - 10) + c, abs(r - 59_000) + 1 - c) for r in range(60_000) for c in range(2))
    assert d.agg(F.sum("v")).first()[0] == want


def test_midpoint_displacement_is_the_same_however_rows_come(spark):
    """Sums of floats depend on their order: the field has to be the same bit by bit under other partitions."""
    from gridframe.core import GridFrame, GridMeta, blank
    from gridframe.plans.storage import setting

    meta, fields = GridMeta(0, 90, 0, 90, 90, 90), []
    for n in ("1", "7", "13"):
        with setting(spark, "spark.sql.shuffle.partitions", n), setting(spark, "spark.sql.adaptive.enabled", "false"):
            fields.append(o.texture(GridFrame(meta, blank(spark, meta)), "diamondSquare", name="t").pull("t"))
    assert fields[0] == fields[1] == fields[2]


@pytest.mark.parametrize("routing", ["straight", "cheapest"])
def test_class_distances_near_and_far_over_tiles(spark, monkeypatch, routing):
    """Mixed classes and classes far apart, over small tiles: distances, and of equal pairs of cells the first, are brute force's."""
    import importlib

    module = importlib.import_module("gridframe.operators.distance")
    rng = random.Random(5)
    m = [[0] * 30 for _ in range(70)]
    for _ in range(150):
        m[rng.randrange(70)][rng.randrange(14)] = rng.randint(1, 4)
    for k, (r, c) in enumerate([(0, 29), (69, 29), (35, 25), (35, 27), (2, 2)]):
        m[r][c] = 5 + k
    at = {}
    for r in range(70):
        for c in range(30):
            at.setdefault(m[r][c], []).append((r, c))
    cost = lambda y, x: math.hypot(y, x) if routing == "straight" else max(y, x) + (math.sqrt(2) - 1) * min(y, x)
    want = {(a, b): min((round(cost(abs(r - y), abs(c - x)), 9), r, c, y, x) for r, c in at[a] for y, x in at[b]) for a in at for b in at if 0 < a < b}
    monkeypatch.setattr(module, "TILE", 16)
    got = module.nearest_cells(grid(spark, (0, 30, 0, 70), 1, m), "values", "euclidean" if routing == "straight" else "octile").collect()
    assert {(x["a"], x["b"]): (round(x["d"], 9), x["r0"], x["c0"], x["r1"], x["c1"]) for x in got} == want


@pytest.mark.parametrize("method", ["zhangSuen", "homotopic"])
def test_skeletons_over_tiles(spark, monkeypatch, method):
    """Small tiles that hear of each other every round or every few give the skeleton that one tile gives, with few stored tables."""
    from gridframe.operators import thinning

    rng = random.Random(3)
    m = [[int(rng.random() < 0.8 or 8 < r < 24) for c in range(37)] for r in range(43)]
    keep = [[int(rng.random() < 0.03) for c in range(37)] for r in range(43)]
    found = []
    for side, halo in ((64, 16), (8, 2), (9, 8)):
        monkeypatch.setattr(thinning, "TILE", side)
        monkeypatch.setattr(thinning, "HALO", halo)
        found.append(o.skeletonise(grid(spark, (0, 37, 0, 43), 1, {"m": m, "keep": keep}), 0, "keep", method, "m", "s").pull("s"))
    assert 0 < sum(found[0]) < sum(map(sum, m)) and found[0] == found[1] == found[2]


def test_lines_over_tiles(spark, monkeypatch):
    """Small tiles give the cells of samples every tenth of a cell, the largest id on each; samples are never rows of a table."""
    from gridframe.operators import raster

    rng = random.Random(8)
    ends = [(k, *(round(rng.uniform(-3, 43), 2) for _ in range(4))) for k in range(60)] + [(60, 5.5, 3.0, 5.5, 38.0), (61, 2.0, 7.5, 39.0, 7.5)]
    want = {}
    for k, x, y, x2, y2 in ends:
        n = max(2, math.ceil(math.sqrt((x2 - x) ** 2 + (y2 - y) ** 2) / 0.1) + 1)
        for i in range(n):
            u, v = x + i / (n - 1) * (x2 - x), y + i / (n - 1) * (y2 - y)
            if 0 <= u <= 40 and 0 <= v <= 40:
                want[(39 if v == 0 else math.floor(40 - v), 39 if u == 40 else math.floor(u))] = float(k)
    monkeypatch.setattr(raster, "TILE", 8)
    monkeypatch.setattr(raster, "SAMPLES", 50)
    rows = spark.createDataFrame([p for k, x, y, x2, y2 in ends for p in ((k, 0, 0, x, y), (k, 0, 1, x2, y2))], "id int, part int, seq int, x double, y double")
    g = o.rasterise(grid(spark, (0, 40, 0, 40), 1, [[0] * 40] * 40), rows, "line", "v")
    assert {(x["r"], x["c"]): x["v"] for x in g.cells.filter("v is not null").collect()} == want


def test_random_cluster_fills_by_rounds(spark, monkeypatch):
    """The rule in plain Python; no round sends the cells to the driver, however small their files are."""
    from gridframe.functions.random import uniform
    from gridframe.operators import draw

    plans = []

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return draw_stored(df, tag)

    draw_stored = draw.stored
    monkeypatch.setattr(draw, "stored", noted)
    g = grid(spark, (0, 12, 0, 10), 1, [[0] * 12] * 10)
    out = o.cluster(g, "randomCluster", p=0.05, n=3, name="out", seed=4)
    assert len(plans) > 3
    assert not any("Broadcast" in p for p in [*plans[1:], out.cells._jdf.queryExecution().executedPlan().toString()])

    on = o.cluster(g, p=0.05, name="on", seed=4)
    labels = o.componentise(on, 4, layer="on", add="patch").cells.filter("patch is not null")
    first = labels.groupBy("patch").agg(F.min(F.col("r").cast("long") * 12 + F.col("c")).alias("root"))
    start = labels.join(first, "patch").select("r", "c", (F.floor(uniform(5, F.col("root")) * 3) + 1).cast("double").alias("v"))
    keys = spark.range(12 * 10 * 3 * 40).select((F.col("id") % 12).cast("int").alias("c"), (F.col("id") / 12 % 10).cast("int").alias("r"), (F.floor(F.col("id") / 120) % 3 + 1).cast("double").alias("v"), (F.floor(F.col("id") / 360) + 1).cast("int").alias("k"))
    luck = {(x["k"], x["r"], x["c"], x["v"]): x["u"] for x in keys.select("*", uniform(6, F.col("k"), F.col("r"), F.col("c"), F.col("v")).alias("u")).collect()}
    known, k = {(x["r"], x["c"]): x["v"] for x in start.collect()}, 0
    while len(known) < 120:
        k, new = k + 1, {}
        for r in range(10):
            for c in range(12):
                near = [known[a] for a in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if a in known]
                if (r, c) not in known and near:
                    new[r, c] = min(near, key=lambda v: luck[k, r, c, v])
        known |= new
    assert k > 2 and out.pull("out") == [known[r, c] for r in range(10) for c in range(12)]


def test_loops_over_tiles(spark, monkeypatch):
    """Rounds in small tiles give what rounds over whole layers give; many rounds need few stored tables."""
    import gridframe.plans.loop as loops
    from gridframe.plans import rounds, storage

    rng, made, tiled, new_path = random.Random(3), [], rounds.tiled, storage.new_path
    some = lambda kinds: "/".join("".join(rng.choice(kinds) for _ in range(11)) for _ in range(13))
    g = o.mask_filter(drawn(spark, some("0111")), "values = 1", add="mask").put_from("out", drawn(spark, some("0001.")).values())
    monkeypatch.setattr(storage, "new_path", lambda spark, tag: made.append(tag) or new_path(spark, tag))
    snake = drawn(spark, "1111111111/0000000001/1111111111/1000000000/1111111111".replace("1", "2").replace("2", "0", 1))
    snake = o.mask_filter(o.mask_filter(snake, "values = 2 OR (r = 0 AND c = 0)", add="mask"), "r = 0 AND c = 0", add="out")
    way = loop(snake, o.mask_filter(o.dilate(layer="out"), "out = 1 AND mask = 1", add="out"), stable=True, layer="out")
    assert sum(way.pull("out")) == 32 and way.provenance[-1]["activity"] == {"iterations": 32} and len(made) <= 8
    monkeypatch.setattr(rounds, "TILE", 5)
    monkeypatch.setattr(rounds, "HALO", 4)
    for recipe, until, runs in (
        (o.mask_filter(o.dilate(struct=o.structure("square", 3), layer="out", add="out"), "out = 1 AND mask = 1", add="out"), {"stable": True}, True),
        (o.dilate(o.erode(struct=o.structure("cross", 5), layer="out", add="out"), layer="out", struct=[(0, 2, 1.0), (1, -1, 3.0)]), {"stable": True, "times": 6}, True),
        (o.mask_filter(o.dilate(layer="out"), "NOT (out = 1 AND c > 3) OR out IS NULL", add="out"), {"times": 5}, True),
        (o.mask_filter(o.dilate(layer="out"), "abs(out) = 1", add="out"), {"times": 2}, False),
    ):
        assert (tiled(g, recipe, "out", until.get("times", math.inf), "stable" in until) is not None) == runs
        monkeypatch.setattr(loops, "tiled", tiled)
        a = loop(g, recipe, layer="out", **until)
        monkeypatch.setattr(loops, "tiled", lambda *_: None)
        b = loop(g, recipe, layer="out", **until)
        assert (a.pull("out"), a.names, a.provenance[-1]["activity"]) == (b.pull("out"), b.names, b.provenance[-1]["activity"])


def test_rounds_are_dealt_to_tasks(spark, monkeypatch):
    """Tiles of few bytes run in several tasks, not all in one; the layer is as cell by cell."""
    from gridframe.plans import rounds

    tables, put = [], rounds.stored
    monkeypatch.setattr(rounds, "TILE", 4)
    monkeypatch.setattr(rounds, "stored", lambda df, tag: tables.append((tag, put(df, tag))) or tables[-1][1])
    on = {(3, 5), (60, 30), (61, 2)}
    m = [[float((r, c) in on) for c in range(40)] for r in range(64)]
    out = loop(grid(spark, (0, 40, 0, 64), 1, m), o.dilate(), times=3)
    assert out.pull() == [float(any(abs(r - i) + abs(c - j) <= 3 for i, j in on)) for r in range(64) for c in range(40)]
    files = [len(t.inputFiles()) for tag, t in tables[2:] if tag == "rounds"]
    assert files and min(files) > 4


def test_dilating_few_cells_sends_few_rows(spark):
    """Cells that can't change a neighbour of a binary layer send nothing; null cells stay, and so do zeros among nulls."""

    def shuffled(plan) -> list:
        """Rows that each exchange of a plan that ran wrote, the last exchange first."""
        name, below = plan.nodeName(), plan.children()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [below.apply(i) for i in range(below.size())]
        own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
        return own + [n for p in inner for n in shuffled(p)]

    rng, n, ring = random.Random(8), 60, [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    m = [[rng.choice([0.0] * 40 + [1.0, None, None]) for _ in range(n)] for _ in range(n)]
    m[0][:3], m[1][:3] = [0.0, None, 0.0], [None, None, 0.0]
    for op, merged, gate in ((o.dilate, max, 0.0), (o.erode, min, 1.0)):
        k = [[v if v is None else abs(v - gate) for v in row] for row in m]
        g = o.offset(grid(spark, (0, n, 0, n), 1, k), "+", 0)
        g = replace(g, cells=g.cells.repartition(8, "r", "c"))
        out = op(g).cells
        got = {(x["r"], x["c"]): x["values"] for x in out.collect()}
        near = lambda r, c: [k[r + i][c + j] for i, j in ring if 0 <= r + i < n and 0 <= c + j < n and k[r + i][c + j] is not None]
        assert got == {(r, c): merged(near(r, c)) if k[r][c] == gate else k[r][c] for r in range(n) for c in range(n)}
        assert shuffled(out._jdf.queryExecution().executedPlan())[0] < 1.5 * n * n
    lone = drawn(spark, "0./.1")
    for kernel, v in (([(0, 1, 1.0), (1, 0, 1.0)], None), ([(0, 0, 1.0), (0, 1, 1.0)], 0.0)):
        assert o.dilate(lone, kernel).pull() == [v, None, None, 1.0]

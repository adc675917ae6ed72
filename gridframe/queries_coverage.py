"""More queries over the supply grid, one for each operator and variant that the headline queries leave out, with their SQL."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from gridframe import operators as o
from gridframe import sources
from gridframe.core import GridFrame, Recipe, register, replay
from gridframe.functions.equation import metric
from gridframe.operators.raster import from_wkt, spaghetti
from gridframe.operators.stencil import structure, turned
from gridframe.plans.loop import loop
from gridframe.plans.patterns import pattern_classes
from gridframe.plans.storage import new_path
from gridframe.queries import _AWAY, _HOPS, NCOL, SQL, _layer, _stencil, drawn_kernel, kernel, query, sql, supply


def _value(name: str, run, value: str, places: int | None = None, more: str = "") -> None:
    """A layer whose value SQL has as an expression over a cell."""
    _layer(name, run, sql(f"SELECT r, c, {f'round({value}, {places}) + 0.0' if places is not None else value} AS v FROM cells", more), places)


# cell by cell
for _name, _fun, _by, _v in (("plus", "+", 7, "n + 7"), ("minus", "-", 7, "n - 7"), ("times", "*", 7, "n * 7"), ("divide", "/", 7, "n / 7"), ("power", "^", 2, "n * n")):
    _value(f"offset_{_name}", lambda g, f=_fun, b=_by: o.offset(g, f, b, layer="n", add="out"), _v, 6)
for _name, _fun, _v in (("plus", "+", "qty + n"), ("times", "*", "qty * n"), ("divide", "/", "qty / nullif(n, 0)"), ("modulo", "%%", "qty - floor(qty / nullif(n, 0)) * n"), ("floor_divide", "%/%", "floor(qty / nullif(n, 0))")):
    _value(f"blend_{_name}", lambda g, f=_fun: o.blend(g, ["qty", "n"], f, add="out"), _v, 6)
_value("blend_power", lambda g: o.blend(g, ["n", "mask"], "^", add="out"), "pow(n, mask)", 6)
for _fun, _v in (
    ("sum", "coalesce(qty, 0) + n + mask"), ("min", "least(qty, n, mask)"), ("median", "list_aggregate([qty, n, mask], 'median')"), ("any", "(coalesce(qty, 0) <> 0 OR n <> 0 OR mask <> 0)::INT::DOUBLE"),
    ("all", "(coalesce(qty, 1) <> 0 AND n <> 0 AND mask <> 0)::INT::DOUBLE"), ("n", "3.0::DOUBLE"),
    ("unique", "CASE WHEN len(list_distinct([nullif(qty, 0), nullif(n, 0), nullif(mask, 0)])) = 1 THEN greatest(qty, n, mask) END"),
):
    _value(f"blend_{_fun}", lambda g, f=_fun: o.blend(g, ["qty", "n", "mask"], f, add="out"), _v, 6)
_value("filter_range_or", lambda g: o.mask_filter(g, ~F.col("n").between(2, 5) | (F.col("qty") > 200), add="out"), "CASE WHEN NOT n BETWEEN 2 AND 5 OR coalesce(qty > 200, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_value("permute_ascending", lambda g: o.permute(g, "ascending", layer="n", add="out"), "n")
_value("replace_null", lambda g: o.replace_values(g, [None], [-1], layer="qty", add="out"), "coalesce(qty, -1)")
_value(
    "categorise_shares", lambda g: o.categorise(g.put("rank", (F.col("r") * NCOL + F.col("c")).cast("double")), shares=[0.25, 0.5, 0.25], layer="rank", add="out"),
    f"CASE WHEN r * {NCOL} + c < round_even(0.25 * {NCOL} * k, 0) THEN 1.0::DOUBLE WHEN r * {NCOL} + c < round_even(0.75 * {NCOL} * k, 0) THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END".replace(" k,", " (SELECT k FROM s),"),
)
_layer("perturb", lambda g: o.perturb(g, 2.0, layer="n", add="out"), None, 6)

# neighbourhoods
_disc, _diamond, _cross = structure("disc", 3), structure("diamond", 3), structure("cross", 5)
_SQUARE, _DIAMOND, _WEIGHTED = drawn_kernel("111/111/111"), drawn_kernel(".1./111/.1."), drawn_kernel(".1./121/.1.")
_all = "SELECT cells.r, cells.c, m.v FROM cells LEFT JOIN m ON cells.r = m.r AND cells.c = m.c"
for _name, _merge, _v in (("all", "all", "min((@ <> 0)::INT)::DOUBLE"), ("not_all", "!all", "1 - min((@ <> 0)::INT)::DOUBLE"), ("not_any", "!any", "1 - max((@ <> 0)::INT)::DOUBLE"), ("cv", "cv", "round(stddev_samp(@) / nullif(avg(@), 0), 6)"), ("sum_or_null", "sumNa", "nullif(sum(@), 0)")):
    _stencil(f"morph_{_name}", lambda g, m=_merge: o.morph(g, _cross, "identity", m, layer="n", add="out"), drawn_kernel("..1../..1../11111/..1../..1.."), _v, _all, "n", 6)
_stencil("morph_strict", lambda g: o.morph(g, _disc, "identity", "sum", strict=True, layer="n", add="out"), _SQUARE, "CASE WHEN count(*) = 9 THEN sum(@) END", _all, "n")
_ones = structure(custom=[[1, 1, 1], [1, 1, 1], [1, 1, 1]])
_stencil("morph_equal", lambda g: o.morph(g, _ones, "equal", "max", layer="mask", add="out"), _SQUARE, "min((@ = k.w)::INT)::DOUBLE", _all, "mask")
_stencil("morph_background", lambda g: o.morph(g, _disc, "identity", "max", background=-1, layer="qty", add="out"), _SQUARE, "max(@)", "SELECT cells.r, cells.c, CASE WHEN cells.qty IS NULL THEN -1 ELSE coalesce(m.v, -1) END AS v FROM cells LEFT JOIN m ON cells.r = m.r AND cells.c = m.c")
_grown = "SELECT cells.r, cells.c, CASE WHEN cells.n <> 0 THEN m.v ELSE cells.n END AS v FROM cells JOIN m ON cells.r = m.r AND cells.c = m.c"
_weighted = structure(custom=[[None, 1, None], [1, 2, 1], [None, 1, None]])
_stencil("dilate_classes", lambda g: o.dilate(g, layer="n", add="out"), _DIAMOND, "max(@)", _grown, "n")
_stencil("erode_classes", lambda g: o.erode(g, layer="n", add="out"), _DIAMOND, "min(@)", _grown, "n")
_stencil("dilate_weighted", lambda g: o.dilate(g, _weighted, layer="n", add="out"), _WEIGHTED, "max(@ + k.w)", _grown, "n")
_stencil("erode_weighted", lambda g: o.erode(g, _weighted, layer="n", add="out"), _WEIGHTED, "min(@ - k.w)", _grown, "n")
_corner = structure(custom=[[0, 0, None], [0, 1, None], [None, None, None]])
_turns = [_corner, turned(_corner), turned(turned(_corner)), turned(turned(turned(_corner)))]
_layer(
    "match_rotated", lambda g: o.match(g, _corner, background=0, layer="mask", add="out"),
    sql(
        "SELECT cells.r, cells.c, coalesce(t.v, 0.0::DOUBLE) AS v FROM cells LEFT JOIN t ON cells.r = t.r AND cells.c = t.c",
        ", k AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {i}, {j}, {w}::DOUBLE)" for t, turn in enumerate(_turns) for i, j, w in turn) + ") AS t(t, i, j, w))"
        f", m AS (SELECT k.t, x.r - k.i AS r, x.c - k.j AS c FROM cells x, k GROUP BY 1, 2, 3 HAVING count(*) = {len(_corner)} AND min((x.mask = k.w)::INT) = 1), t AS (SELECT r, c, 1.0::DOUBLE AS v FROM m GROUP BY 1, 2)",
    ),
)


def around(rows: str, cols: list[str], keep: str = "") -> str:
    """SQL of rows(r, c, ..) with each column's eight neighbours: <col>_nw, _n, .. _se (null outside)."""
    rest = "".join(f", {x}" for x in keep.split()) if keep else ""
    first = ", ".join(f"{x}, lag({x}) OVER (PARTITION BY c ORDER BY r) AS {x}_n, lead({x}) OVER (PARTITION BY c ORDER BY r) AS {x}_s" for x in cols)
    wide = ", ".join(
        f"{x}, {x}_n, {x}_s, lag({x}) OVER a AS {x}_w, lead({x}) OVER a AS {x}_e, lag({x}_n) OVER a AS {x}_nw, lead({x}_n) OVER a AS {x}_ne, lag({x}_s) OVER a AS {x}_sw, lead({x}_s) OVER a AS {x}_se" for x in cols
    )
    return f"SELECT r, c{rest}, {wide} FROM (SELECT r, c{rest}, {first} FROM {rows}) WINDOW a AS (PARTITION BY r ORDER BY c)"


_RING = ("n", "ne", "e", "se", "s", "sw", "w", "nw")


def _thinned(rounds: int, passes: list[str]) -> str:
    """SQL of synchronous passes in turn over the mask; `rounds` of them, enough for it to be stable."""
    n = [f"coalesce(v_{x}, 0)" for x in _RING]
    count, turns = " + ".join(n), " + ".join(f"({n[k]} = 0 AND {n[(k + 1) % 8]} = 1)::INT" for k in range(8))
    simple = " + ".join(f"((1 - {n[k]}) - (1 - {n[k]}) * (1 - {n[(k + 1) % 8]}) * (1 - {n[(k + 2) % 8]}))" for k in (0, 2, 4, 6))
    tests = " WHEN ".join(f"i % {len(passes)} = {k} AND ({p})" for k, p in enumerate(passes)).replace("#count", f"({count})").replace("#turns", f"({turns})").replace("#simple", f"({simple})")
    for k, x in enumerate(n):
        tests = tests.replace(f"#{k}", x)
    tests = tests.replace(" WHEN ", " THEN 0.0::DOUBLE WHEN ")
    step = f"SELECT i + 1, r, c, CASE WHEN v = 0 THEN 0.0::DOUBLE WHEN {tests} THEN 0.0::DOUBLE ELSE v END FROM ({around('t', ['v'], 'i')}) WHERE i < {rounds}"
    return sql(f"SELECT r, c, v FROM t WHERE i = {rounds}", f", t(i, r, c, v) AS (SELECT 0, r, c, mask FROM cells UNION ALL {step})", True)


SQL["skeleton_zhang_suen"] = _thinned(60, ["#count BETWEEN 2 AND 6 AND #turns = 1 AND #0 * #2 * #4 = 0 AND #2 * #4 * #6 = 0", "#count BETWEEN 2 AND 6 AND #turns = 1 AND #0 * #2 * #6 = 0 AND #0 * #4 * #6 = 0"])
# a cell's code: 1 set, plus 2 simple, plus 4 for each cell set around it; even rounds make codes, odd rounds take cells away
_on, _free, _cnt = ({x: f % f"coalesce(v_{x}, 0)" for x in _RING} for f in ("(%s > 0)", "(floor(%s / 2) %% 2 = 1)", "floor(%s / 4)"))
_PAIRS = {"w": "n nw s sw", "e": "n ne s se", "n": "w nw e ne", "s": "w sw e se", "nw": "w n", "sw": "s w", "ne": "n e", "se": "e s"}
_fine, _alone, _both = [], "false", "false"
for _k, _beside in _PAIRS.items():  # the last of the simple neighbours in this order decides
    _p = [_on[x] for x in _beside.split()]
    if len(_p) == 4:
        _n = " + ".join(f"{x}::INT" for x in _p)
        _ok, _one, _two = f"(({_p[0]} OR {_p[1]}) <> ({_p[2]} OR {_p[3]}))", f"({_n} = 1)", f"({_n} = 2 AND ({_p[0]} = {_p[1]}))"
    else:
        _ok, _one, _two = f"({_p[0]} OR {_p[1]})", f"({_p[0]} <> {_p[1]})", f"({_p[0]} AND {_p[1]})"
    _fine.append(f"(NOT {_free[_k]} OR {_ok})")
    _alone, _both = f"CASE WHEN {_free[_k]} THEN {_one} ELSE {_alone} END", f"CASE WHEN {_free[_k]} THEN {_two} ELSE {_both} END"
_many = "(" + " + ".join(f"{_free[x]}::INT" for x in _PAIRS) + ")"
_alike = " AND ".join(f"(NOT {_free[x]} OR {_cnt[x]} = {_many})" for x in _PAIRS)
_go = f"floor(v / 2) % 2 = 1 AND {' AND '.join(_fine)} AND NOT ((({_many} = 2 AND ({_alone})) OR ({_many} = 3 AND ({_both}))) AND {_alike})"
_set = [f"coalesce(v_{x}, 0)" for x in _RING]
_simple = " + ".join(f"((1 - {_set[k]}) - (1 - {_set[k]}) * (1 - {_set[(k + 1) % 8]}) * (1 - {_set[(k + 2) % 8]}))" for k in (0, 2, 4, 6))
SQL["skeleton_homotopic"] = sql(
    "SELECT r, c, v FROM t WHERE i = 120",
    f", t(i, r, c, v) AS (SELECT 0, r, c, mask FROM cells UNION ALL SELECT i + 1, r, c, CASE WHEN v = 0 THEN 0.0::DOUBLE WHEN i % 2 = 0 THEN (1 + 2 * ({_simple} = 1)::INT + 4 * ({' + '.join(_set)}))::DOUBLE"
    f" WHEN {_go} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM ({around('t', ['v'], 'i')}) WHERE i < 120)", True,
)
_steps = ", ".join(f"d_{x} + (k + k_{x}) / 2 * {'sqrt(2)' if len(x) == 2 else '1.0'}" for x in _RING)
SQL["cost_distance"] = sql(
    "SELECT r, c, round(d, 6) AS v FROM t WHERE i = 120",
    f", t(i, r, c, k, d) AS (SELECT 0, r, c, n + 1, CASE WHEN qty >= 280 THEN 0.0::DOUBLE END FROM cells UNION ALL SELECT i + 1, r, c, k, least(d, {_steps}) FROM ({around('t', ['k', 'd'], 'i')}) WHERE i < 120)", True,
)
_sides = {x: f"coalesce(v_{x}, {y})" for x, y in (("n", "v"), ("s", "v"), ("w", "v"), ("e", "v"), ("nw", "coalesce(v_n, v_w, v)"), ("ne", "coalesce(v_n, v_e, v)"), ("sw", "coalesce(v_s, v_w, v)"), ("se", "coalesce(v_s, v_e, v)"))}
SQL["hillshade"] = sql(
    "SELECT r, c, round(greatest(0.0, sin(radians(45)) * cos(slope) + cos(radians(45)) * sin(slope) * cos(radians(315) - aspect)), 6) + 0.0 AS v FROM lit",
    f", w AS ({around('(SELECT r, c, n AS v FROM cells)', ['v'])})"
    ", d AS (SELECT r, c, (({ne} + 2 * {e} + {se}) - ({nw} + 2 * {w} + {sw})) / 8 AS dx, (({sw} + 2 * {s} + {se}) - ({nw} + 2 * {n} + {ne})) / 8 AS dy FROM w)".format(**_sides)
    + ", lit AS (SELECT r, c, atan(sqrt(dx * dx + dy * dy)) AS slope, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE atan2(-dx, dy) END AS aspect FROM d)",
)

_least = ", ".join(f"m_{x}" for x in _RING)
SQL["componentise_8"] = sql(
    "SELECT r, c, CASE WHEN m IS NOT NULL THEN dense_rank() OVER (ORDER BY m) END::DOUBLE AS v FROM t WHERE i = 400",
    f", t(i, r, c, m) AS (SELECT 0, r, c, CASE WHEN mask = 1 THEN r * {NCOL} + c END FROM cells UNION ALL SELECT i + 1, r, c, CASE WHEN m IS NOT NULL THEN least(m, {_least}) END FROM ({around('t', ['m'], 'i')}) WHERE i < 400)", True,
)

# zones and distances
_zoned = lambda g: o.replace_values(g, [0], [None], layer="n", add="z")
for _fun, _v in (
    ("mean", "round(avg(qty), 6)"), ("max", "max(qty)"), ("min", "min(qty)"), ("median", "median(qty)"), ("any", "max((mask <> 0)::INT)::DOUBLE"), ("all", "min((mask <> 0)::INT)::DOUBLE"),
    ("n", "count(*)::DOUBLE"), ("n_distinct", "count(DISTINCT nullif(qty, 0))::DOUBLE"), ("unique", "CASE WHEN count(DISTINCT nullif(mask, 0)) = 1 THEN max(mask) END"),
):
    _layer(
        f"summarise_{_fun}", lambda g, f=_fun: o.summarise(_zoned(g), "z", f, layer="mask" if f in ("any", "all", "unique") else "qty", add="out"),
        sql("SELECT cells.r, cells.c, CASE WHEN cells.n <> 0 THEN z.s END AS v FROM cells LEFT JOIN z ON z.n = cells.n", f", z AS (SELECT n, {_v} AS s FROM cells GROUP BY n)"), 6,
    )
_layer(
    "summarise_neighbours4", lambda g: o.summarise(_zoned(g), "z", "n", neighbours=True, connectivity=4, background=0, layer="qty", add="out"),
    sql("SELECT cells.r, cells.c, CASE WHEN cells.n <> 0 THEN z.s ELSE 0 END AS v FROM cells LEFT JOIN z ON z.n = cells.n", f", h AS (SELECT * FROM (VALUES {_HOPS[4]}) AS t(i, j)), z AS (SELECT x.n, count(*)::DOUBLE AS s FROM cells x, h, cells y WHERE y.n <> x.n AND y.r = x.r + h.i AND y.c = x.c + h.j GROUP BY 1)"),
)
_CENTRES = ", z AS (SELECT n AS id, avg(r) AS y, avg(c) AS x FROM cells WHERE n <> 0 GROUP BY n), p AS (SELECT round_even(y, 0)::INT AS r, round_even(x, 0)::INT AS c, max(id) AS id FROM z GROUP BY 1, 2)"
_layer("centroid", lambda g: o.centroid(g, layer="n", add="out"), sql("SELECT cells.r, cells.c, p.id AS v FROM cells LEFT JOIN p USING (r, c)", _CENTRES.replace("WHERE n <> 0 ", "")))
_layer(
    "centroid_shifted", lambda g: o.centroid(replace(g, meta=replace(g.meta, xmin=1.25, xmax=NCOL + 1.25, ymin=-0.5, ymax=g.meta.nrow - 0.5)), layer="n", add="out"),
    sql("SELECT cells.r, cells.c, p.id AS v FROM cells LEFT JOIN p USING (r, c)", _CENTRES.replace("WHERE n <> 0 ", "").replace("round_even(y, 0)", "least((SELECT k FROM s) - 1, greatest(0, ceil(round_even(y - 0.5, 0) + 0.5 - 0.5)))").replace("round_even(x, 0)", f"least({NCOL} - 1, greatest(0, ceil(round_even(x + 1.25, 0) - 1.25 - 0.5)))")),
)
_layer("nearest_class", lambda g: o.nearest_class(g, layer="n", add="out"), sql("SELECT r, c, first(id ORDER BY round((r - y) * (r - y) + (c - x) * (c - x), 9), id) AS v FROM cells, z GROUP BY 1, 2", _CENTRES))
_layer(
    "distance_to_own_target", lambda g: o.distance(o.centroid(g, layer="n", add="mid"), "mid", layer="n", add="out"),
    sql("SELECT x.r, x.c, round(min(sqrt((x.r - p.r) * (x.r - p.r) + (x.c - p.c) * (x.c - p.c))), 6) AS v FROM cells x LEFT JOIN p ON p.id = x.n GROUP BY 1, 2", _CENTRES), 6,
)
_layer(
    "distance_background", lambda g: o.distance(o.mask_filter(g, ~F.coalesce(F.col("qty") >= 280, F.lit(False)), add="near"), "background", "manhattan", layer="near", add="out"),
    sql("SELECT x.r, x.c, min(abs(x.r - y.r) + abs(x.c - y.c))::DOUBLE AS v FROM cells x, (SELECT r, c FROM cells WHERE qty >= 280) y GROUP BY 1, 2"),
)

# generators
_Y, _PX, _PY = "((SELECT k FROM s) - 1 - r)", f"({NCOL} - 1) / 2", "((SELECT k FROM s) - 1) / 2"
_UNIT = "SELECT r, c, round((z - lo) / (hi - lo), 6) + 0.0 AS v FROM z, (SELECT min(z) AS lo, max(z) AS hi FROM z)"
for _kind, _z in (
    ("line", f"abs(-(c - {_PX}) * sin(radians(30)) + ({_Y} - {_PY}) * cos(radians(30)))"), ("circle", f"abs(sqrt(pow(c - {_PX}, 2) + pow({_Y} - {_PY}, 2)) - 5)"), ("square", f"abs(greatest(abs(c - {_PX}), abs({_Y} - {_PY})) - 5)"),
):
    _layer(f"gradient_{_kind}", lambda g, k=_kind: o.gradient(g, k, 30, size=5, name="out"), sql(_UNIT, f", z AS (SELECT r, c, {_z} AS z FROM cells)"), 6)
_layer(
    "gradient_origin_inverted", lambda g: o.gradient(o.mask_filter(g, "qty >= 280", add="far"), origin="far", invert=True, name="out"),
    sql(_UNIT.replace("(z - lo) / (hi - lo)", "1 - (z - lo) / (hi - lo)"), ", z AS (SELECT x.r, x.c, min(sqrt((x.r - y.r) * (x.r - y.r) + (x.c - y.c) * (x.c - y.c))) AS z FROM cells x, (SELECT r, c FROM cells WHERE qty >= 280) y GROUP BY 1, 2)"), 6,
)
_XY = f", p AS (SELECT r, c, c::DOUBLE / {NCOL} * 4 AS x, r::DOUBLE / (SELECT k FROM s) * 4 AS y FROM cells), q AS (SELECT *, (x - 2) * cos(radians(30)) + (y - 2) * sin(radians(30)) AS across, sqrt(pow(x - 2, 2) + pow(y - 2, 2)) AS around FROM p)"
for _kind, _v in (
    ("stripes", "floor(across + 4) % 2 + 1"), ("rings", "floor(2 * around) % 2 + 1"), ("waves", "round((sin(2 * pi() * across) + 1) / 2, 6)"),
    ("grid", f"(floor(x) <> floor((c - 1)::DOUBLE / {NCOL} * 4) OR floor(y) <> floor((r - 1)::DOUBLE / (SELECT k FROM s) * 4))::INT::DOUBLE"),
):
    _layer(f"pattern_{_kind}", lambda g, k=_kind: o.pattern(g, k, 4, angle=30, name="out"), sql(f"SELECT r, c, ({_v})::DOUBLE AS v FROM q", _XY), 6)
_layer("pattern_checkerboard_tiles", lambda g: o.pattern(g, "checkerboard", 4, 0, name="out"), sql("SELECT r, c, floor(y) * 4 + floor(x) + 1 AS v FROM q", _XY))
_HEX = (
    f", p AS (SELECT r, c, c::DOUBLE / {NCOL} * 6 AS x, r::DOUBLE / (SELECT k FROM s) * 6 AS y FROM cells), ax AS (SELECT r, c, (sqrt(3) / 3 * x - y / 3) * 2 AS q, 2 * y * 2 / 3 AS s FROM p)"
    ", b AS (SELECT *, round_even(q, 0) AS rq, round_even(s, 0) AS rs, round_even(-q - s, 0) AS rt FROM ax), d AS (SELECT *, abs(rq - q) AS dq, abs(rs - s) AS ds, abs(rt - (-q - s)) AS dt FROM b)"
    ", h AS (SELECT r, c, CASE WHEN dq > ds AND dq > dt THEN -rs - rt ELSE rq END AS q, CASE WHEN dq > ds AND dq > dt THEN rs WHEN ds > dt THEN -rq - rt ELSE rs END AS s FROM d)"
)
_layer("pattern_hexagonal_classes", lambda g: o.pattern(g, "hexagonal", 6, 3, name="out"), sql("SELECT r, c, ((q - s)::BIGINT % 3 + 3) % 3 + 1.0::DOUBLE AS v FROM h", _HEX))
SQL["pattern_hexagonal"] = sql("SELECT r, c, dense_rank() OVER (ORDER BY f)::DOUBLE AS v FROM (SELECT r, c, min(r * 100 + c) OVER (PARTITION BY q, s) AS f FROM h)", _HEX)
_rng = np.random.default_rng(1)
_SEEDS = ", ".join(f"({i + 1}::DOUBLE, {_rng.random()!r}::DOUBLE, {_rng.random()!r}::DOUBLE)" for i in range(20))
SQL["tessellation_voronoi"] = sql(f"SELECT r, c, first(id ORDER BY round(pow(r - u * (SELECT k FROM s), 2) + pow(c - w * {NCOL}, 2), 9), id) AS v FROM cells, (VALUES {_SEEDS}) AS t(id, u, w) GROUP BY 1, 2")
for _name, _run in (
    ("noise_white", lambda g: o.noise(g, "white", name="out")), ("texture_billow", lambda g: o.texture(g, "billow", name="out")), ("texture_ridged", lambda g: o.texture(g, "ridged", "simplex", name="out")),
    ("cluster_random", lambda g: o.cluster(g, "randomCluster", name="out")), ("tessellation_gibbs", lambda g: o.tessellation(g, "gibbs", name="out")),
):
    _layer(_name, _run, None, 6)

# layers, recipes, sources and sinks
_layer("add_select_remove", lambda g: o.blend(o.add_layers(o.select(g, "n"), o.remove(g, "n"), rename={"qty": "amount"}), ["n", "amount", "mask"], "+", add="out"), sql("SELECT r, c, n + qty + mask AS v FROM cells"))
_layer("replay_history", lambda g: replay(g, o.offset(o.blend(g, ["qty", "n"], "-", add="out"), "*", 2, layer="out")), sql("SELECT r, c, (qty - n) * 2 AS v FROM cells"))
_layer("loop_times", lambda g: loop(g.put("out", F.col("n")), o.offset(Recipe(), "+", 2, layer="out"), 3, layer="out"), sql("SELECT r, c, n + 6 AS v FROM cells"))


def _reread(g: GridFrame) -> GridFrame:
    path = new_path(g.cells.sparkSession, "grid")
    sources.write(g, path)
    return sources.read(g.cells.sparkSession, path)


_layer("write_and_read", lambda g: _reread(o.area(g, layer="n")), sql("SELECT r, c, qty AS v FROM cells"), out="qty")
_layer("resize_down", lambda g: o.resize(g, 0.5), sql("SELECT CAST(r / 2 AS INTEGER) AS r, CAST(c / 2 AS INTEGER) AS c, n AS v FROM cells WHERE r % 2 = 0 AND c % 2 = 0 AND r < (SELECT k // 2 * 2 FROM s)"), out="n")

# vector geometry
_ENDS = f"(s_nationkey * 3) % {NCOL} + 0.5::DOUBLE AS x, k - s_suppkey - 0.5::DOUBLE AS y, (s_suppkey * 7) % {NCOL} + 0.5::DOUBLE AS x2, (s_nationkey * 11) % k + 0.5::DOUBLE AS y2"


@query(
    "rasterise_lines",
    sql(
        "SELECT cells.r, cells.c, CAST(g.id AS DOUBLE) AS v FROM cells LEFT JOIN g ON g.r = cells.r AND g.c = cells.c",
        f", e AS (SELECT s_suppkey AS id, {_ENDS}, k FROM supplier, s), seg AS (SELECT *, greatest(2, ceil(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) / 0.1::DOUBLE)::INT + 1) AS m FROM e), t AS (SELECT *, unnest(range(0, m)) AS i FROM seg)"
        ", g AS (SELECT floor(k - (y + i::DOUBLE / (m - 1) * (y2 - y)))::INT AS r, floor(x + i::DOUBLE / (m - 1) * (x2 - x))::INT AS c, max(id) AS id FROM t GROUP BY 1, 2)",
    ),
)
def rasterise_lines(spark, sf_dir):
    g = supply(spark, sf_dir)
    k = g.meta.nrow
    ends = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("id"), F.lit(0).alias("part"),
        F.posexplode(F.array(
            F.struct(((F.col("s_nationkey") * 3) % NCOL + 0.5).alias("x"), (k - F.col("s_suppkey") - 0.5).alias("y")),
            F.struct(((F.col("s_suppkey") * 7) % NCOL + 0.5).alias("x"), ((F.col("s_nationkey") * 11) % k + 0.5).alias("y")),
        )).alias("seq", "p"),
    )
    return o.rasterise(g, ends.select("id", "part", "seq", "p.x", "p.y"), "line", "v").cells.select("r", "c", "v")


@query(
    "rasterise_polygons",
    sql(
        "SELECT cells.r, cells.c, max(i.id)::DOUBLE AS v FROM cells LEFT JOIN i ON i.r = cells.r AND i.c = cells.c GROUP BY 1, 2",
        ", t AS (SELECT n_nationkey AS id, n_nationkey * 3 + 0.13::DOUBLE AS ax, 1.17::DOUBLE AS ay, n_nationkey * 3 + 19.29::DOUBLE AS bx, k - 1.31::DOUBLE AS b_y, n_nationkey * 2 + 1.71::DOUBLE AS cx, k * 0.61::DOUBLE AS cy FROM nation, s)"
        ", e AS (SELECT id, ax AS x1, ay AS y1, bx AS x2, b_y AS y2 FROM t UNION ALL SELECT id, bx, b_y, cx, cy FROM t UNION ALL SELECT id, cx, cy, ax, ay FROM t)"
        ", p AS (SELECT r, c, c + 0.5::DOUBLE AS px, k - r - 0.5::DOUBLE AS py FROM cells, s)"
        ", i AS (SELECT r, c, id FROM p, e WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)",
    ),
)
def rasterise_polygons(spark, sf_dir):
    g = supply(spark, sf_dir)
    k, n = g.meta.nrow, F.col("n_nationkey")
    at = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    rings = F.array(F.array(at(n * 3 + 0.13, 1.17), at(n * 3 + 19.29, k - 1.31), at(n * 2 + 1.71, k * 0.61)))
    shapes = spaghetti(spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("id"), rings.alias("rings")))
    return o.rasterise(g, shapes, "polygon", "v").cells.select("r", "c", "v")


@query("rasterise_well_known_text", SQL["rasterise_polygons"])
def rasterise_well_known_text(spark, sf_dir):
    g = supply(spark, sf_dir)
    k, n = g.meta.nrow, F.col("n_nationkey")
    at = [(n * 3 + 0.13, F.lit(1.17)), (n * 3 + 19.29, F.lit(k - 1.31)), (n * 2 + 1.71, F.lit(k * 0.61)), (n * 3 + 0.13, F.lit(1.17))]
    vertices = F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in at])
    texts = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("id"), F.concat(F.lit("POLYGON(("), vertices, F.lit("))")).alias("wkt"))
    return o.rasterise(g, *from_wkt(texts), "v").cells.select("r", "c", "v")


@query("ascii_written_and_read", sql("SELECT r, c, qty AS v FROM cells"))
def ascii_written_and_read(spark, sf_dir):
    g, path = supply(spark, sf_dir), new_path(spark, "ascii")
    rows = g.cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", F.coalesce("qty", F.lit(-9999.0)).alias("v")))).alias("cells"))
    head = [f"ncols {NCOL}", f"nrows {g.meta.nrow}", "xllcorner 0", "yllcorner 0", "cellsize 1", "NODATA_value -9999"]
    lines = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "r int, value string").unionByName(rows.select("r", F.array_join(F.transform("cells", lambda x: x["v"].cast("string")), " ").alias("value")))
    lines.orderBy("r").coalesce(1).select("value").write.text(path)
    return sources.read_ascii(spark, path, "v").cells.select("r", "c", "v")


@query("grouped_values", sql("SELECT CAST(n AS INTEGER) AS gid, CAST(CAST(n AS BIGINT) AS VARCHAR) AS val FROM cells GROUP BY n"))
def grouped_values(spark, sf_dir):
    return sources.grouped(supply(spark, sf_dir), "n").table("n").select("gid", "val")


# measures and equations
@query("label", sql("SELECT CAST(mask AS INTEGER) AS gid, CASE mask WHEN 1 THEN 'stocked' ELSE '0' END AS val FROM cells GROUP BY mask"))
def label(spark, sf_dir):
    return o.label(supply(spark, sf_dir), {1: "stocked"}, layer="mask").table("mask").select("gid", "val")


@query("perimeter_cells", SQL["perimeter"])
def perimeter_cells(spark, sf_dir):
    return o.perimeter(supply(spark, sf_dir), unit="cells", layer="n").table("n").select("gid", "perimeter")


_ALL = ", few AS (SELECT * FROM cells WHERE n <> 0)"
_LENGTHS = {"straight": "sqrt((x.r - y.r) * (x.r - y.r) + (x.c - y.c) * (x.c - y.c))", "cheapest": "greatest(abs(x.r - y.r), abs(x.c - y.c)) + (sqrt(2) - 1) * least(abs(x.r - y.r), abs(x.c - y.c))"}


def _class_distance(routing: str) -> None:
    oracle = sql(f"SELECT x.n AS a, y.n AS b, round(CASE WHEN x.n = y.n THEN 'Infinity'::DOUBLE ELSE min({_LENGTHS[routing]}) END, 6) AS value FROM few x, few y GROUP BY 1, 2", _ALL)
    query(f"class_distance_{routing}", oracle)(lambda spark, sf_dir: o.class_distance(supply(spark, sf_dir), routing, layer="n").pairs[("n", "distance")].select("a", "b", F.round("value", 6).alias("value")))


_class_distance("straight")
_class_distance("cheapest")


@query("nearest_other_class", sql(f"SELECT CAST(x.n AS INTEGER) AS gid, round(min({_LENGTHS['straight']}), 6) AS enn FROM few x LEFT JOIN few y ON x.n <> y.n GROUP BY 1", _ALL))
def nearest_other_class(spark, sf_dir):
    g = metric(o.class_distance(supply(spark, sf_dir), "straight", layer="n"), "min(distance.others)", "enn", layer="n")
    return g.table("n").filter("gid <> 0").select("gid", F.round("enn", 6).alias("enn"))


_ENDS_OF = ", e AS (SELECT x.n AS a, y.n AS b, min((pow(x.r - y.r, 2) + pow(x.c - y.c, 2), x.r, x.c, y.r, y.c)) AS e FROM few x, few y WHERE x.n < y.n GROUP BY 1, 2), ends AS (SELECT a, b, e[2] AS r0, e[3] AS c0, e[4] AS r1, e[5] AS c1 FROM e)"
_LINE = (
    ", t AS (SELECT a, b, r0, c0, r1, c1, greatest(abs(r1 - r0), abs(c1 - c0)) AS m, unnest(range(0, greatest(abs(r1 - r0), abs(c1 - c0))::BIGINT + 1)) AS i FROM ends)"
    ", d AS (SELECT t.a, t.b, sum(k.n + 1) AS v FROM t JOIN cells k ON k.r = round_even(r0 + (r1 - r0) * i::DOUBLE / m, 0) AND k.c = round_even(c0 + (c1 - c0) * i::DOUBLE / m, 0) GROUP BY 1, 2)"
)


@query(
    "class_distance_along_lines",
    sql("SELECT a, b, v::DOUBLE AS value FROM d UNION ALL SELECT b, a, v::DOUBLE FROM d UNION ALL SELECT DISTINCT n, n, 'Infinity'::DOUBLE FROM few", _ALL + _ENDS_OF + _LINE),
)
def class_distance_along_lines(spark, sf_dir):
    g = o.offset(supply(spark, sf_dir), "+", 1, layer="n", add="k")
    return o.class_distance(g, "straight", cost="k", layer="n").pairs[("n", "distance")]


# what is known of whole layers, histories and tables
@query("categorise_labels", sql("SELECT CASE WHEN qty < 50 THEN 1 WHEN qty < 100 THEN 2 WHEN qty < 200.5 THEN 3 ELSE 4 END AS gid, CASE WHEN qty < 50 THEN concat(lo, '-50') WHEN qty < 100 THEN '50-100' WHEN qty < 200.5 THEN '100-200.5' ELSE concat('200.5-', hi) END AS val FROM cells, (SELECT min(qty)::BIGINT AS lo, max(qty)::BIGINT AS hi FROM cells) WHERE qty IS NOT NULL GROUP BY 1, 2"))
def categorise_labels(spark, sf_dir):
    return o.categorise(supply(spark, sf_dir), breaks=[50, 100, 200.5], layer="qty", add="out").table("out").select("gid", "val")


_OTHERS = {
    "median": "median(y.qty)", "sd": "stddev_samp(y.qty)", "var": "var_samp(y.qty)", "any": "max((y.qty <> 0)::INT)::DOUBLE", "all": "min((y.qty <> 0)::INT)::DOUBLE", "sum": "sum(y.qty)", "min": "min(y.qty)", "max": "max(y.qty)", "length": "count(y.qty)::DOUBLE",
}
for _fun, _v in _OTHERS.items():
    _counted = _v if _fun != "length" else "count(*)::DOUBLE"

    @query(f"others_{_fun}", sql(f"SELECT CAST(x.n AS INTEGER) AS gid, round((SELECT {_counted} FROM cells y WHERE y.n <> x.n), 4) AS v FROM (SELECT DISTINCT n FROM cells) x"))
    def _others(spark, sf_dir, fun=_fun):
        return metric(supply(spark, sf_dir), f"{fun}(qty.others)", "out", layer="n").table("n").select("gid", F.round("out", 4).alias("v"))


@query("history_of_a_loop", sql("SELECT * FROM (VALUES (1, 'mask_filter', 'out', NULL), (2, 'dilate', 'grown', NULL), (3, 'loop', '', (SELECT greatest(1, max(d)) + (max(d) > 0)::INT FROM m))) AS t(step, fn, made, iterations)", _AWAY))
def history_of_a_loop(spark, sf_dir):
    g = o.dilate(o.mask_filter(supply(spark, sf_dir), "qty >= 280", add="out"), layer="out", add="grown")
    path = new_path(spark, "grid")
    sources.write(loop(g, o.dilate(layer="out", add="out"), stable=True, layer="out"), path)
    rows = [(h["step"], h["fn"], ",".join(h["made"]), h.get("activity", {}).get("iterations")) for h in sources.read(spark, path).provenance]
    return spark.createDataFrame(rows, "step int, fn string, made string, iterations int")


@query("pairs_written_and_read", SQL["adjacency4"])
def pairs_written_and_read(spark, sf_dir):
    path = new_path(spark, "grid")
    sources.write(o.adjacency(supply(spark, sf_dir), 4, layer="n"), path)
    return sources.read(spark, path).pairs[("n", "adjacency")]


@query("overall", sql("SELECT round(max(k) * 1.0::DOUBLE, 6) AS largest, round(avg(k), 6) AS average FROM (SELECT count(*) AS k FROM cells GROUP BY n)"))
def overall(spark, sf_dir):
    g = metric(o.area(supply(spark, sf_dir), layer="n"), "max(area.all)", "largest", layer="n")
    t = metric(g, "mean(area.all)", "average", layer="n").table("n", overall=True)
    return t.select(F.round("largest", 6).alias("largest"), F.round("average", 6).alias("average"))


# functions of one's own
register("halved", lambda v: v / 2)
register("apart", lambda a, b: F.abs(a - b))
register("extent", lambda v: F.max(v) - F.min(v), aggregate=True)
_value("blend_own_function", lambda g: o.blend(g, ["qty", "n"], "apart", add="out"), "abs(qty - n)", 6)
_layer("summarise_own_function", lambda g: o.summarise(_zoned(g), "z", "extent", layer="qty", add="out"), sql("SELECT r, c, CASE WHEN n <> 0 THEN max(qty) OVER (PARTITION BY n) - min(qty) OVER (PARTITION BY n) END AS v FROM cells"), 6)


@query("equation_own_function", sql("SELECT CAST(n AS INTEGER) AS gid, round((max(qty) - min(qty)) / 2, 6) AS v FROM cells GROUP BY n"))
def equation_own_function(spark, sf_dir):
    return metric(supply(spark, sf_dir), "halved(extent(qty.self))", "out", layer="n").table("n").select("gid", F.round("out", 6).alias("v"))


# shapes of structuring elements, and chains of operators
_wide = structure("diamond", 7, 3)
_stencil("morph_wide_diamond", lambda g: o.morph(g, _wide, "identity", "sum", layer="n", add="out"), drawn_kernel("..111../1111111/..111.."), "sum(@)", _all, "n")
_flat = structure("disc", 5, 3)
_stencil("morph_wide_disc", lambda g: o.morph(g, _flat, "identity", "sum", layer="n", add="out"), drawn_kernel(".111./11111/.111."), "sum(@)", _all, "n")



def _islets(g: GridFrame) -> GridFrame:
    g = o.mask_filter(o.distance(g, "background", layer="mask", add="depth"), "mask = 1 AND depth > sqrt(2)", add="core")
    g = o.componentise(g, 8, background=0, layer="mask", add="part")
    g = o.summarise(g, "part", "any", background=0, layer="core", add="cored")
    return o.mask_filter(g, "mask = 1 AND cored = 0", add="out")


_layer(
    "islets", _islets,
    sql(
        "SELECT cells.r, cells.c, (mask = 1 AND f.id IS NULL)::INT::DOUBLE AS v FROM cells LEFT JOIN f ON f.id = cells.r * 100 + cells.c",
        f", on_ AS (SELECT r, c, CAST(r * 100 + c AS BIGINT) AS id FROM cells WHERE mask = 1), h AS (SELECT * FROM (VALUES {_HOPS[8]}) AS t(i, j))"
        ", rim AS (SELECT DISTINCT x.r, x.c FROM cells x, h, cells y WHERE x.mask = 1 AND y.mask = 0 AND y.r = x.r + h.i AND y.c = x.c + h.j)"
        ", f(id) AS (SELECT id FROM on_ WHERE (r, c) NOT IN (SELECT (r, c) FROM rim) UNION SELECT y.id FROM f JOIN on_ x ON x.id = f.id, h, on_ y WHERE y.r = x.r + h.i AND y.c = x.c + h.j)", True,
    ),
)
_layer("pattern_classes", lambda g: pattern_classes(g, layer="mask", add="out"), None)

# random fields by what they have to hold: every cell, their range, and the same again from the same seed
_FIELDS = {
    "noise_white": (lambda g, s: o.noise(g, "white", name="out", seed=s), 0, 1), "noise_perlin": (lambda g, s: o.noise(g, "perlin", name="out", seed=s), 0, 1), "noise_simplex": (lambda g, s: o.noise(g, "simplex", name="out", seed=s), 0, 1),
    "texture_fbm": (lambda g, s: o.texture(g, "fbm", name="out", seed=s), 0, 1), "texture_billow": (lambda g, s: o.texture(g, "billow", name="out", seed=s), 0, 1), "texture_ridged": (lambda g, s: o.texture(g, "ridged", "simplex", name="out", seed=s), 0, 1),
    "texture_diamond_square": (lambda g, s: o.texture(g, "diamondSquare", name="out", seed=s), 0, 1), "cluster_percolation": (lambda g, s: o.cluster(g, p=0.3, name="out", seed=s), 0, 1), "cluster_random": (lambda g, s: o.cluster(g, "randomCluster", n=3, name="out", seed=s), 1, 3),
    "tessellation_rectangle": (lambda g, s: o.tessellation(g, "rectangle", name="out", seed=s), 1, 10**9), "tessellation_gibbs": (lambda g, s: o.tessellation(g, "gibbs", name="out", seed=s), 1, 20), "perturb": (lambda g, s: o.perturb(g.put("out", F.lit(0.0)), 1.0, s, layer="out"), -7, 7),
}
for _name, (_run, _low, _high) in _FIELDS.items():

    @query(f"{_name}_holds", sql("SELECT count(*) AS cells, count(*) AS inside, count(*) AS repeated, true AS seeded FROM cells"))
    def _holds(spark, sf_dir, run=_run, low=_low, high=_high):
        g = supply(spark, sf_dir)
        one, same, other = (run(g, s).values("out").withColumnRenamed("v", k) for k, s in (("a", 1), ("b", 1), ("d", 2)))
        met = one.join(same, ["r", "c"]).join(other, ["r", "c"])
        return met.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("a").between(low, high), 1)).alias("inside"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("repeated"), (F.count(F.when(F.col("a") != F.col("d"), 1)) > 0).alias("seeded"))


@query("gyrate", sql("SELECT CAST(n AS INTEGER) AS gid, round(avg(sqrt(pow(c - mx, 2) + pow(r - my, 2))), 6) AS gyrate FROM (SELECT n, r, c, avg(c) OVER (PARTITION BY n) AS mx, avg(r) OVER (PARTITION BY n) AS my FROM cells) GROUP BY n"))
def gyrate(spark, sf_dir):
    g = metric(supply(spark, sf_dir), "mean(sqrt((x.self - mean(x.self))^2 + (y.self - mean(y.self))^2))", "gyrate", layer="n")
    return g.table("n").select("gid", F.round("gyrate", 6).alias("gyrate"))


_EDGES = f", h AS (SELECT * FROM (VALUES {_HOPS[4]}) AS t(i, j)), e AS (SELECT x.n, sum((y.n <> x.n)::INT) AS p FROM cells x, h, cells y WHERE y.r = x.r + h.i AND y.c = x.c + h.j GROUP BY 1), u AS (SELECT n, count(*) AS k FROM cells GROUP BY n)"


@query("shape_index", sql("SELECT CAST(n AS INTEGER) AS gid, round(p / (2 * sqrt(pi() * u.k)), 6) AS shape FROM e JOIN u USING (n)", _EDGES))
def shape_index(spark, sf_dir):
    g = o.perimeter(o.area(supply(spark, sf_dir), layer="n"), layer="n")
    return metric(g, "perimeter.self / (2 * sqrt(pi * area.self))", "shape", layer="n").table("n").select("gid", F.round("shape", 6).alias("shape"))


@query("edge_density_and_evenness", sql("SELECT round((SELECT sum(p) FROM e) / (SELECT sum(k) FROM u), 6)::DOUBLE AS density, round((SELECT -sum(w * ln(w)) FROM (SELECT k / (SELECT sum(k) FROM u) AS w FROM u)) / ln((SELECT count(*) FROM u)), 6)::DOUBLE AS evenness", _EDGES))
def edge_density_and_evenness(spark, sf_dir):
    g = o.perimeter(o.area(supply(spark, sf_dir), layer="n"), layer="n")
    g = metric(g, "sum(perimeter.all) / sum(area.all)", "density", layer="n")
    g = metric(g, "-sum(area.all / sum(area.all) * log(area.all / sum(area.all))) / log(length(area.all))", "evenness", layer="n")
    return spark.createDataFrame([(round(g.globals["n"]["density"], 6), round(g.globals["n"]["evenness"], 6))], "density double, evenness double")


@query("area_against_others", sql("SELECT CAST(n AS INTEGER) AS gid, round(k / (SELECT avg(y.k) FROM u y WHERE y.n <> u.n), 6)::DOUBLE AS ratio FROM u", _EDGES))
def area_against_others(spark, sf_dir):
    g = metric(o.area(supply(spark, sf_dir), layer="n"), "area.self / mean(area.others)", "ratio", layer="n")
    return g.table("n").select("gid", F.round("ratio", 6).alias("ratio"))

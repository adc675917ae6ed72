"""Queries over grids derived from the driver's tables, and the same in DuckDB's SQL.

The supply grid has a row for each supplier and 100 columns (part number modulo 100): qty is the sum of l_quantity (null
where none), n the number of line items, mask 1 where qty >= 150.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe import operators as o
from gridframe.core import GridFrame, GridMeta, Recipe, blank, replay
from gridframe.functions.equation import metric
from gridframe.operators.stencil import structure
from gridframe.plans.loop import loop

NCOL, LEAST = 100, 150


def supply(spark: SparkSession, sf_dir: str) -> GridFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nrow = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    by = lines.groupBy(F.col("l_suppkey").cast("int").alias("r"), (F.col("l_partkey") % NCOL).cast("int").alias("c")).agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).cast("double").alias("n"))
    meta = GridMeta(0, NCOL, 0, nrow, NCOL, nrow)
    cells = blank(spark, meta).join(by, ["r", "c"], "left")
    return GridFrame(meta, cells.select("r", "c", "qty", F.coalesce("n", F.lit(0.0)).alias("n"), F.when(F.col("qty") >= LEAST, 1.0).otherwise(0.0).alias("mask")))


_CELLS = f"""
    s AS (SELECT CAST(count(*) AS INTEGER) AS k FROM supplier),
    a AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT unnest(range(0, (SELECT k FROM s))) AS r), (SELECT unnest(range(0, {NCOL})) AS c)),
    l AS (SELECT l_suppkey AS r, l_partkey % {NCOL} AS c, sum(l_quantity) AS qty, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
    cells AS (SELECT a.r, a.c, l.qty, coalesce(l.n, 0.0) AS n, CASE WHEN l.qty >= {LEAST} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM a LEFT JOIN l ON a.r = l.r AND a.c = l.c)"""
_HOPS = {4: "(-1, 0), (0, -1), (0, 1), (1, 0)", 8: "(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)"}


def sql(select: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_CELLS}{more} {select}"


def kernel(offsets: list) -> str:
    return ", k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {w}::DOUBLE)" for i, j, w in offsets) + ") AS t(i, j, w))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _layer(name: str, run: Callable[[GridFrame], GridFrame], oracle: str | None, places: int | None = None, out: str = "out") -> None:
    """A query that returns r, c and one layer."""

    def f(spark, sf_dir):
        g = run(supply(spark, sf_dir))
        v = F.col(out).cast("double")
        return g.cells.select("r", "c", (F.round(v, places) + 0.0 if places is not None else v).alias("v"))

    query(name, oracle)(f)


_layer("filter_mask", lambda g: o.mask_filter(g, "qty > 100 AND n < 6", add="out"), sql("SELECT r, c, CASE WHEN qty > 100 AND n < 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM cells"))
_layer("filter_value", lambda g: o.mask_filter(g, "n >= 5", value=True, layer="qty", add="out"), sql("SELECT r, c, CASE WHEN n >= 5 THEN qty END AS v FROM cells"))
_layer("value_range", lambda g: o.value_range(g, 50, 200, layer="qty", add="out"), sql("SELECT r, c, CASE WHEN qty BETWEEN 50 AND 200 THEN qty END AS v FROM cells"))
_layer("replace_values", lambda g: o.replace_values(g, [1, 2, 3], [3, 1, None], layer="n", add="out"), sql("SELECT r, c, CASE n WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE n END AS v FROM cells"))
_layer("categorise_breaks", lambda g: o.categorise(g, breaks=[50, 100, 200], layer="qty", add="out"), sql("SELECT r, c, CASE WHEN qty IS NOT NULL THEN 1.0 + (qty >= 50)::INT + (qty >= 100)::INT + (qty >= 200)::INT END::DOUBLE AS v FROM cells"))
_layer("categorise_bins", lambda g: o.categorise(g, n=4, layer="n", add="out"), sql("SELECT r, c, (1 + (n >= lo + (hi - lo) / 4)::INT + (n >= lo + (hi - lo) * 2 / 4)::INT + (n >= lo + (hi - lo) * 3 / 4)::INT)::DOUBLE AS v FROM cells, (SELECT min(n) AS lo, max(n) AS hi FROM cells)"))
_layer("scale", lambda g: o.scale(g, (0, 10), layer="qty", add="out"), sql("SELECT r, c, round((qty - lo) / (hi - lo) * 10, 6) + 0.0 AS v FROM cells, (SELECT min(qty) AS lo, max(qty) AS hi FROM cells)"), 6)
_layer("offset_modulo", lambda g: o.offset(g, "%%", 7, layer="qty", add="out"), sql("SELECT r, c, qty - floor(qty / 7) * 7 AS v FROM cells"))
_layer("offset_floor_divide", lambda g: o.offset(g, "%/%", 7, layer="qty", add="out"), sql("SELECT r, c, floor(qty / 7) AS v FROM cells"))
_layer("permute_invert", lambda g: o.permute(g, "invert", layer="n", add="out"), sql("SELECT r, c, (SELECT max(n) FROM cells) - n AS v FROM cells"))
_layer("permute_revert", lambda g: o.permute(g, "revert", layer="n", add="out"), sql("SELECT r, c, w.n AS v FROM cells JOIN u ON u.n = cells.n JOIN u w ON w.k = (SELECT max(k) FROM u) + 1 - u.k", ", u AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT DISTINCT n FROM cells))"))
_layer("permute_cycle", lambda g: o.permute(g, "cycle", 2, layer="n", add="out"), sql("SELECT r, c, CASE WHEN n + 2 > m THEN n + 2 - m ELSE n + 2 END AS v FROM cells, (SELECT max(n) AS m FROM cells)"))
_layer("blend_subtract", lambda g: o.blend(g, ["qty", "n"], "-", add="out"), sql("SELECT r, c, qty - n AS v FROM cells"))
_layer("blend_mean", lambda g: o.blend(g, ["qty", "n", "mask"], "mean", [1, 2, 3], add="out"), sql("SELECT r, c, round((coalesce(qty, 0) + 2 * n + 3 * mask) / (2 + (qty IS NOT NULL)::INT), 6) AS v FROM cells"), 6)
_layer("blend_max", lambda g: o.blend(g, ["qty", "n"], "max", add="out"), sql("SELECT r, c, greatest(qty, n) AS v FROM cells"))
_layer("blend_distinct", lambda g: o.blend(g, ["n", "mask"], "n_distinct", add="out"), sql("SELECT r, c, ((n <> 0)::INT + (mask <> 0 AND mask <> n)::INT)::DOUBLE AS v FROM cells"))


def drawn_kernel(text: str) -> list[tuple[int, int, float]]:
    """Offsets from rows of digits parted by "/", "." for outside: the SQL's kernels, written out."""
    rows = text.split("/")
    return [(i - len(rows) // 2, j - len(rows[0]) // 2, float(x)) for i, row in enumerate(rows) for j, x in enumerate(row) if x != "."]


def _stencil(name: str, run, offsets: list, value: str, select: str = "SELECT cells.r, cells.c, m.v FROM cells LEFT JOIN m ON cells.r = m.r AND cells.c = m.c", layer: str = "qty", places: int | None = None) -> None:
    merged = f", m AS (SELECT x.r - k.i AS r, x.c - k.j AS c, {value} AS v FROM cells x, k GROUP BY 1, 2)".replace("@", f"x.{layer}")
    _layer(name, run, sql(select, kernel(offsets) + merged), places)


_disc, _diamond = structure("disc", 5), structure("diamond", 3)
_DISC, _DIAMOND = drawn_kernel(".111./11111/11111/11111/.111."), drawn_kernel(".1./111/.1.")
_stencil("dilate", lambda g: o.dilate(g, layer="mask", add="out"), _DIAMOND, "max(@)", "SELECT cells.r, cells.c, CASE WHEN cells.mask = 0 THEN m.v ELSE cells.mask END AS v FROM cells JOIN m ON cells.r = m.r AND cells.c = m.c", "mask")
_stencil("erode", lambda g: o.erode(g, layer="mask", add="out"), _DIAMOND, "min(@)", "SELECT cells.r, cells.c, CASE WHEN cells.mask = 1 THEN m.v ELSE cells.mask END AS v FROM cells JOIN m ON cells.r = m.r AND cells.c = m.c", "mask")
_own = "SELECT cells.r, cells.c, CASE WHEN cells.qty IS NOT NULL THEN m.v END AS v FROM cells LEFT JOIN m ON cells.r = m.r AND cells.c = m.c"
_weights = structure(custom=[[1, 2, 1], [2, 4, 2], [1, 2, 1]])
_WEIGHTS = drawn_kernel("121/242/121")
for _merge, _value in (("min", "min(@)"), ("max", "max(@)"), ("sum", "sum(@)"), ("mean", "round(avg(@), 6)"), ("median", "round(median(@), 6)"), ("sd", "round(stddev_samp(@), 6)"), ("any", "max((@ <> 0)::INT)::DOUBLE")):
    _stencil(f"morph_{_merge}", lambda g, m=_merge: o.morph(g, _disc, "identity", m, layer="qty", add="out"), _DISC, _value, _own, places=6)
for _blend, _value in (("plus", "max(@ + k.w)"), ("minus", "max(@ - k.w)"), ("product", "max(@ * k.w)"), ("lower", "max(CASE WHEN @ > k.w THEN 0 ELSE @ END)"), ("greater", "max(CASE WHEN @ < k.w THEN 0 ELSE @ END)")):
    _stencil(f"morph_{_blend}", lambda g, b=_blend: o.morph(g, _weights, b, "max", layer="qty", add="out"), _WEIGHTS, _value, _own, places=6)
_stencil("interpolate", lambda g: o.interpolate(g, _weights, layer="qty", add="out"), _WEIGHTS, "round(sum(@ * k.w) / count(@), 6)", places=6)
_pattern = structure(custom=[[0, 0, 0], [0, 1, 0], [0, 0, 0]])
_stencil("match", lambda g: o.match(g, _pattern, rotate=False, background=0, layer="mask", add="out"), drawn_kernel("000/010/000"), "CASE WHEN count(*) = 9 AND min((@ = k.w)::INT) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", layer="mask")

_FLOOD = {
    k: f""", on_ AS (SELECT r, c, CAST(r * {NCOL} + c AS BIGINT) AS id FROM cells WHERE mask = 1),
    h AS (SELECT * FROM (VALUES {_HOPS[k]}) AS t(i, j)),
    e AS (SELECT x.id AS a, y.id AS b FROM on_ x, h, on_ y WHERE y.r = x.r + h.i AND y.c = x.c + h.j),
    f(id, root) AS (SELECT id, id FROM on_ UNION SELECT e.b, f.root FROM f JOIN e ON e.a = f.id WHERE e.b > f.root),
    p AS (SELECT id, min(root) AS root FROM f GROUP BY id),
    q AS (SELECT root, CAST(row_number() OVER (ORDER BY root) AS DOUBLE) AS v FROM (SELECT DISTINCT root FROM p))"""
    for k in (4,)
}
_layer("componentise", lambda g: o.componentise(g, 4, layer="mask", add="out"), sql(f"SELECT cells.r, cells.c, q.v FROM cells LEFT JOIN p ON p.id = cells.r * {NCOL} + cells.c LEFT JOIN q USING (root)", _FLOOD[4], True))
_layer("componentise_8", lambda g: o.componentise(g, 8, layer="mask", add="out"), None)
_layer("summarise_within", lambda g: o.summarise(o.replace_values(g, [0], [None], layer="n", add="z"), "z", "sum", layer="qty", add="out"), sql("SELECT r, c, CASE WHEN n <> 0 THEN coalesce(sum(qty) OVER (PARTITION BY n), 0) END AS v FROM cells"))
_layer(
    "summarise_neighbours", lambda g: o.summarise(g, "mask", "sum", neighbours=True, layer="n", add="out"),
    sql("SELECT r, c, CASE WHEN mask = 1 THEN s END AS v FROM cells, (SELECT sum(y.n) AS s FROM cells x, h, cells y WHERE x.mask = 1 AND y.mask <> 1 AND y.r = x.r + h.i AND y.c = x.c + h.j)", f", h AS (SELECT * FROM (VALUES {_HOPS[8]}) AS t(i, j))"),
)
for _m, _d in (("euclidean", "sqrt((x.r - y.r) * (x.r - y.r) + (x.c - y.c) * (x.c - y.c))"), ("manhattan", "(abs(x.r - y.r) + abs(x.c - y.c))"), ("chessboard", "greatest(abs(x.r - y.r), abs(x.c - y.c))")):
    _layer(f"distance_{_m}", lambda g, m=_m: o.distance(o.mask_filter(g, "qty >= 280", add="far"), "foreground", m, layer="far", add="out"), sql(f"SELECT x.r, x.c, round(min({_d})::DOUBLE, 6) AS v FROM cells x, (SELECT r, c FROM cells WHERE qty >= 280) y GROUP BY 1, 2"), 6)
_layer(
    "fill", lambda g: o.fill(g, 4, layer="mask", add="out"),
    sql(
        f"SELECT cells.r, cells.c, CASE WHEN p.id IS NOT NULL AND NOT open.o THEN 1.0::DOUBLE ELSE cells.mask END AS v FROM cells LEFT JOIN p ON p.id = cells.r * {NCOL} + cells.c LEFT JOIN open USING (root)",
        _FLOOD[4].replace("mask = 1", "mask = 0") + f", open AS (SELECT p.root, bool_or(on_.r IN (0, (SELECT k - 1 FROM s)) OR on_.c IN (0, {NCOL} - 1)) AS o FROM p JOIN on_ ON on_.id = p.id GROUP BY 1)", True,
    ),
)
_layer("cost_distance", lambda g: o.distance(o.offset(o.mask_filter(g, "qty >= 280", add="far"), "+", 1, layer="n", add="k"), cost="k", layer="far", add="out"), None, 6)
_layer("skeleton_zhang_suen", lambda g: o.skeletonise(g, 0, layer="mask", add="out"), None)
_layer("skeleton_homotopic", lambda g: o.skeletonise(g, 0, method="homotopic", layer="mask", add="out"), None)
_layer(
    "recipe_replay", lambda g: replay(g, o.erode(o.dilate(Recipe(), layer="mask", add="out"), layer="out", add="out")),
    sql(
        "SELECT d.r, d.c, CASE WHEN d.v = 1 THEN m.v ELSE d.v END AS v FROM d JOIN m ON d.r = m.r AND d.c = m.c",
        kernel(_DIAMOND) + ", w AS (SELECT x.r - k.i AS r, x.c - k.j AS c, max(x.mask) AS v FROM cells x, k GROUP BY 1, 2)"
        ", d AS (SELECT cells.r, cells.c, CASE WHEN cells.mask = 0 THEN w.v ELSE cells.mask END AS v FROM cells JOIN w ON cells.r = w.r AND cells.c = w.c)"
        ", m AS (SELECT x.r - k.i AS r, x.c - k.j AS c, min(x.v) AS v FROM d x, k GROUP BY 1, 2)",
    ),
)
_FAR = "(SELECT r, c FROM cells WHERE qty >= 280)"
_AWAY = f", m AS (SELECT x.r, x.c, min(abs(x.r - y.r) + abs(x.c - y.c)) AS d FROM cells x, {_FAR} y GROUP BY 1, 2)"
_grown = lambda g: o.mask_filter(g, "qty >= 280", add="out")
_layer("loop_three_times", lambda g: loop(_grown(g), o.dilate(layer="out", add="out"), 3, layer="out"), sql("SELECT r, c, (d <= 3)::INT::DOUBLE AS v FROM m", _AWAY))
_layer(
    "loop_until_half", lambda g: loop(_grown(g), o.dilate(layer="out", add="out"), until="avg(out) >= 0.5", layer="out"),
    sql("SELECT r, c, (d <= t.t)::INT::DOUBLE AS v FROM m, t", _AWAY + ", t AS (SELECT min(u) AS t FROM (SELECT unnest(range(1, 1000)) AS u) WHERE (SELECT avg((d <= u)::INT) FROM m) >= 0.5)"),
)
_layer(
    "loop_until_stable", lambda g: loop(_grown(g), o.mask_filter(o.dilate(struct=structure("square", 3), layer="out", add="out"), "out = 1 AND mask = 1", add="out"), stable=True, layer="out"),
    sql(
        "SELECT cells.r, cells.c, (f.id IS NOT NULL)::INT::DOUBLE AS v FROM cells LEFT JOIN f ON f.id = cells.r * 100 + cells.c",
        f", on_ AS (SELECT r, c, CAST(r * 100 + c AS BIGINT) AS id FROM cells WHERE mask = 1), h AS (SELECT * FROM (VALUES {_HOPS[8]}) AS t(i, j)), f(id) AS (SELECT CAST(r * 100 + c AS BIGINT) FROM {_FAR} UNION SELECT y.id FROM f JOIN on_ x ON x.id = f.id, h, on_ y WHERE y.r = x.r + h.i AND y.c = x.c + h.j)", True,
    ),
)


def _eight_times(g: GridFrame) -> GridFrame:
    g = _grown(g)
    for _ in range(8):
        g = o.dilate(g, layer="out", add="out")
    return g


_layer("dilate_eight_times", _eight_times, sql("SELECT r, c, (d <= 8)::INT::DOUBLE AS v FROM m", _AWAY))
_layer("gradient_planar", lambda g: o.gradient(g, "planar", 30, name="out"), sql("SELECT r, c, round((z - lo) / (hi - lo), 6) + 0.0 AS v FROM z, (SELECT min(z) AS lo, max(z) AS hi FROM z)", ", z AS (SELECT r, c, c * cos(radians(30)) + ((SELECT k FROM s) - 1 - r) * sin(radians(30)) AS z FROM cells)"), 6)
_layer("gradient_point", lambda g: o.gradient(g, "point", position=(10, 20), name="out"), sql("SELECT r, c, round((z - lo) / (hi - lo), 6) + 0.0 AS v FROM z, (SELECT min(z) AS lo, max(z) AS hi FROM z)", ", z AS (SELECT r, c, sqrt(pow(c - 10, 2) + pow((SELECT k FROM s) - 1 - r - 20, 2)) AS z FROM cells)"), 6)
_layer("pattern_checkerboard", lambda g: o.pattern(g, "checkerboard", 4, name="out"), sql(f"SELECT r, c, ((floor(c / {NCOL}.0 * 4) + floor(CAST(r AS DOUBLE) / (SELECT k FROM s) * 4)) % 2 + 1)::DOUBLE AS v FROM cells"))
for _kind, _f in (("noise_perlin", lambda g: o.noise(g, "perlin", name="out")), ("noise_simplex", lambda g: o.noise(g, "simplex", name="out")), ("texture_fbm", lambda g: o.texture(g, "fbm", name="out")), ("texture_diamond_square", lambda g: o.texture(g, "diamondSquare", name="out")), ("pattern_hexagonal", lambda g: o.pattern(g, "hexagonal", 6, 0, name="out")), ("cluster_percolation", lambda g: o.cluster(g, name="out")), ("tessellation_voronoi", lambda g: o.tessellation(g, name="out")), ("tessellation_rectangle", lambda g: o.tessellation(g, "rectangle", name="out")), ("hillshade", lambda g: o.hillshade(g, layer="n", add="out"))):
    _layer(_kind, _f, None, 6)


def _geometry(name: str, run: Callable[[GridFrame], GridFrame], oracle: str) -> None:
    query(name, oracle)(lambda spark, sf_dir: run(supply(spark, sf_dir)).cells.select("r", "c", F.col("n").alias("v")))


_geometry("crop", lambda g: o.crop(g, (9.5, 40, 2, 8)), sql("SELECT r - (k - 8) AS r, c - 9 AS c, n AS v FROM cells, s WHERE c BETWEEN 9 AND 39 AND r BETWEEN k - 8 AND k - 3"))
_geometry("pad", lambda g: o.pad(g, 1, "left top", 9), sql(f"SELECT r + 1 AS r, c + 1 AS c, n AS v FROM cells UNION ALL SELECT 0, CAST(unnest(range(0, {NCOL} + 1)) AS INTEGER), 9.0 UNION ALL SELECT CAST(unnest(range(1, k + 1)) AS INTEGER), 0, 9.0 FROM s"))
_geometry("rotate90", lambda g: o.rotate(g, 90), sql("SELECT c AS r, k - 1 - r AS c, n AS v FROM cells, s"))
_geometry("rotate180", lambda g: o.rotate(g, 180), sql(f"SELECT k - 1 - r AS r, {NCOL} - 1 - c AS c, n AS v FROM cells, s"))
_geometry("rotate270", lambda g: o.rotate(g, 270), sql(f"SELECT {NCOL} - 1 - c AS r, r AS c, n AS v FROM cells, s"))
_geometry("transpose", lambda g: o.transpose(g), sql("SELECT c AS r, r AS c, n AS v FROM cells"))
_geometry("resize_up", lambda g: o.resize(g, 2), sql("SELECT CAST(2 * r + i AS INTEGER) AS r, CAST(2 * c + j AS INTEGER) AS c, n AS v FROM cells, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)"))


@query("area", sql("SELECT CAST(n AS INTEGER) AS gid, CAST(count(*) AS DOUBLE) AS area FROM cells GROUP BY 1"))
def area(spark, sf_dir):
    return o.area(supply(spark, sf_dir), layer="n").table("n").select("gid", "area")


@query("share_of_landscape", sql("SELECT CAST(mask AS INTEGER) AS gid, CAST(count(*) AS DOUBLE) AS area, round(count(*) * 100.0 / (SELECT count(*) FROM cells), 6)::DOUBLE AS share FROM cells GROUP BY 1"))
def share_of_landscape(spark, sf_dir):
    g = metric(o.area(supply(spark, sf_dir), layer="mask"), "area.self / sum(area.all) * 100", "share", layer="mask")
    return g.table("mask").select("gid", "area", F.round("share", 6).alias("share"))


@query("perimeter", sql("SELECT CAST(x.n AS INTEGER) AS gid, CAST(count(CASE WHEN y.n <> x.n THEN 1 END) AS DOUBLE) AS perimeter FROM cells x, h, cells y WHERE y.r = x.r + h.i AND y.c = x.c + h.j GROUP BY 1", f", h AS (SELECT * FROM (VALUES {_HOPS[4]}) AS t(i, j))"))
def perimeter(spark, sf_dir):
    return o.perimeter(supply(spark, sf_dir), layer="n").table("n").select("gid", "perimeter")


def _adjacency(k: int) -> None:
    oracle = sql("SELECT p.n AS a, q.n AS b, CAST(coalesce(m.k, 0) AS DOUBLE) AS value FROM u p CROSS JOIN u q LEFT JOIN m ON m.a = p.n AND m.b = q.n", f", h AS (SELECT * FROM (VALUES {_HOPS[k]}) AS t(i, j)), u AS (SELECT DISTINCT n FROM cells), m AS (SELECT x.n AS a, y.n AS b, count(*) AS k FROM cells x, h, cells y WHERE y.r = x.r + h.i AND y.c = x.c + h.j GROUP BY 1, 2)")
    query(f"adjacency{k}", oracle)(lambda spark, sf_dir: o.adjacency(supply(spark, sf_dir), k, layer="n").pairs[("n", "adjacency")])


_adjacency(4)
_adjacency(8)


@query("dissimilarity", sql("SELECT CAST(x.mask AS INTEGER) AS gid, sum(CASE WHEN x.mask <> y.mask THEN 0.5 ELSE 0 END)::DOUBLE AS dissimilarity FROM cells x, h, cells y WHERE y.r = x.r + h.i AND y.c = x.c + h.j GROUP BY 1", f", h AS (SELECT * FROM (VALUES {_HOPS[4]}) AS t(i, j))"))
def dissimilarity(spark, sf_dir):
    return o.dissimilarity(supply(spark, sf_dir), {(0, 0): 0, (1, 1): 0, (0, 1): 0.5, (1, 0): 0.5}, layer="mask").table("mask").select("gid", "dissimilarity")


@query("shannon", sql("SELECT round(-sum(p * ln(p)), 6)::DOUBLE AS shannon FROM (SELECT count(*) * 1.0::DOUBLE / (SELECT count(*) FROM cells) AS p FROM cells GROUP BY n)"))
def shannon(spark, sf_dir):
    g = metric(o.area(supply(spark, sf_dir), layer="n"), "-sum(area.all / sum(area.all) * log(area.all / sum(area.all)))", "shannon", layer="n")
    return spark.createDataFrame([(round(g.globals["n"]["shannon"], 6),)], "shannon double")


@query("mean_of_self_and_others", sql("SELECT CAST(mask AS INTEGER) AS gid, round(avg(qty), 6) AS inside, round((SELECT avg(y.qty) FROM cells y WHERE y.mask <> x.mask), 6) AS outside FROM cells x GROUP BY mask"))
def mean_of_self_and_others(spark, sf_dir):
    g = metric(metric(supply(spark, sf_dir), "mean(qty.self)", "inside", layer="mask"), "mean(qty.others)", "outside", layer="mask")
    return g.table("mask").select("gid", F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"))


@query("patch_table", sql("SELECT CAST(q.v AS INTEGER) AS gid, CAST(count(*) AS DOUBLE) AS area, (min(on_.r) > 0 AND min(on_.c) > 0 AND max(on_.r) < (SELECT k FROM s) - 1 AND max(on_.c) < 99)::INT::DOUBLE AS whole FROM p JOIN q USING (root) JOIN on_ ON on_.id = p.id GROUP BY 1", _FLOOD[4], True))
def patch_table(spark, sf_dir):
    g = o.area(o.componentise(supply(spark, sf_dir), layer="mask", add="patch"), layer="patch")
    return metric(g, "complete.self", "whole", layer="patch").table("patch").select("gid", "area", "whole")


@query("rasterise_points", sql("SELECT cells.r, cells.c, CAST(p.id AS DOUBLE) AS v FROM cells LEFT JOIN (SELECT CAST(s_suppkey AS INTEGER) AS r, CAST((s_nationkey * 3) % 100 AS INTEGER) AS c, max(s_suppkey) AS id FROM supplier GROUP BY 1, 2) p ON p.r = cells.r AND p.c = cells.c"))
def rasterise_points(spark, sf_dir):
    g = supply(spark, sf_dir)
    points = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.lit(0).alias("part"), F.lit(0).alias("seq"), ((F.col("s_nationkey") * 3) % 100 + 0.5).alias("x"), (g.meta.ymax - F.col("s_suppkey") - 0.5).alias("y"))
    return o.rasterise(g, points, "point", "v").cells.select("r", "c", "v")



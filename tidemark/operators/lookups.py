"""The spatial joins: nearest point, nearest segment, containment, grid cell.

References are put in order along a space-filling curve and packed into leaves of a few each,
leaves into nodes, and so on. A location goes down from the top, keeping at each level the
nodes that may hold its nearest reference. How deep that goes depends on the number of
references, never on how densely they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import spatial as S
from tidemark.operators import geometry as G
from tidemark.operators.locations import KEYS, finite
from tidemark.plans.staging import staged

#: References of a leaf, children of a node (as powers of two), and nodes at the top at most.
LEAF_BITS, NODE_BITS, TOP = 4, 4, 64
#: Bits of each coordinate that the curve orders by: metres, on the globe.
CURVE_BITS = 24
#: References sorted by one task.
SORTED = 200_000


def _curve(u: Column, v: Column) -> Column:
    """Place along a Hilbert curve of two coordinates in 0..1."""
    top = float((1 << CURVE_BITS) - 1)
    whole = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(top), F.floor(c * (top + 1)))).cast("long")
    start = F.struct(whole(u).alias("x"), whole(v).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(at: Column, s: Column) -> Column:
        rx, ry = (F.when(at[c].bitwiseAND(s) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for c in ("x", "y"))
        # a quarter is entered where the last one was left: mirrored and turned as the curve asks
        flip = (ry == 0) & (rx == 1)
        x, y = (F.when(flip, s - 1 - at[c].bitwiseAND(s - 1)).otherwise(at[c].bitwiseAND(s - 1)) for c in ("x", "y"))
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), (at["d"] * 4 + (rx * 3).bitwiseXOR(ry)).alias("d"))

    sizes = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(CURVE_BITS))])
    return F.aggregate(sizes, start, step)["d"]


def _bounds2(axes: list[str]) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance from a location to a reference inside a node's box."""
    gap = [F.greatest(F.col(f"lo_{a}") - F.col(a), F.lit(0.0), F.col(a) - F.col(f"hi_{a}")) for a in axes]
    reach = [F.greatest(F.abs(F.col(a) - F.col(f"lo_{a}")), F.abs(F.col(a) - F.col(f"hi_{a}"))) for a in axes]
    size = lambda parts: sum((v * v for v in parts[1:]), parts[0] * parts[0])
    return size(gap), size(reach)


def _packed(refs: DataFrame, axes: list[str], order: list[Column], n: int) -> tuple[DataFrame, DataFrame, int]:
    """(references with their leaf, nodes of all levels, number of levels above the leaves).

    ``refs`` carry rpid, lo_ and hi_ of each axis. They are sorted by rpid and by ``order`` and
    numbered; a leaf is 2 ** LEAF_BITS neighbours in that order, and a node 2 ** NODE_BITS
    of the level below. Nodes: (rpid, level, node, up, lo_, hi_), ``up`` being the parent's.
    """
    tasks = n // SORTED + 1
    ordered = refs.withColumn("_o", _curve(*order))
    ordered = ordered.repartitionByRange(tasks, "rpid", "_o") if tasks > 1 else ordered.repartition(1)  # the curve is computed before, by many
    ordered = staged(ordered.sortWithinPartitions("rpid", "_o").drop("_o").withColumn("_at", F.monotonically_increasing_id()))
    if tasks > 1:  # from numbers within a task to numbers within all: a row per task
        task = F.shiftright("_at", 33)
        before = ordered.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
        before = before.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
        ordered = ordered.join(F.broadcast(before), task == F.col("_task")).withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_task", "_before")
    levels = 0
    while n >> (LEAF_BITS + NODE_BITS * levels) > TOP:
        levels += 1
    node = lambda k: F.shiftright("_at", LEAF_BITS + NODE_BITS * k)
    box = [f(f"{side}_{a}").alias(f"{side}_{a}") for a in axes for side, f in (("lo", F.min), ("hi", F.max))]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), node(k).alias("node"), (node(k + 1) if k < levels else F.lit(0).cast("long")).alias("up")) for k in range(levels + 1)]))
    nodes = staged(ordered.select("rpid", *[f"{side}_{a}" for a in axes for side in ("lo", "hi")], at.alias("_n")).groupBy("rpid", "_n.level", "_n.node", "_n.up").agg(*box))
    return ordered.withColumn("leaf", node(0)), nodes, levels


def _descend(locs: DataFrame, refs: DataFrame, nodes: DataFrame, levels: int, axes: list[str], d2: Column, scale: float, keys: list[str]) -> DataFrame:
    """Nearest by bounds, from the top nodes to the leaves: rows (keys, d2, rid), the lowest rid among equals.

    A location keeps the nodes that may hold its nearest reference: those whose least distance
    isn't beyond another's greatest. Each level looks only into what was kept, and the last at
    the references. ``locs`` carry keys, ``axes`` and pid, references and nodes rpid: only equal
    ones meet. Locations are dealt by key once; where nodes are few enough for Spark to
    broadcast, they never move again.
    """
    parts = int(locs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [*keys, *([] if "pid" in keys else ["pid"]), *axes]
    low, high = _bounds2(axes)
    w = Window.partitionBy(*keys)
    slack = 4.0 * (scale * 1e-12) ** 2
    kept = locs.select(*own).repartition(parts, *keys).withColumn("_up", F.lit(0).cast("long"))
    for k in reversed(range(levels + 1)):
        level = nodes.where(F.col("level") == k).drop("level")
        inner = kept.join(level, (F.col("pid") == F.col("rpid")) & (F.col("_up") == F.col("up"))).select(*own, F.col("node").alias("_up"), low.alias("_near"), high.alias("_far"))
        kept = inner.withColumn("_least", F.min("_far").over(w)).where(F.col("_near") <= F.col("_least") * (1 + 4e-9) + slack).select(*own, "_up")
    best = kept.join(refs, (F.col("pid") == F.col("rpid")) & (F.col("_up") == F.col("leaf"))).groupBy(*keys).agg(F.min(F.struct(d2.alias("d2"), F.col("rid").alias("rid"))).alias("_b"))
    return best.select(*keys, "_b.d2", "_b.rid")


def counted(df: DataFrame, n: int | None) -> DataFrame:
    """``df``, which remembers how many references it was answered from: the search counts them anyway."""
    df.n_references = n
    return df


def nearest_points(locs: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (keys, metres, rid): the nearest of ``points`` (rid, lon, lat) on the sphere.

    Rows of ``points`` without finite coordinates are skipped; with none left there is no
    row. Candidate distances are chords, so neither pole nor seam is special.
    """
    x, y, z = S.unit_sphere(F.col("lon"), F.col("lat"))
    refs = points.where(finite(F.col("lon")) & finite(F.col("lat"))).select("rid", x.alias("rx"), y.alias("ry"), z.alias("rz"))
    # of points in one place, the lowest answers for all
    refs = refs.groupBy("rx", "ry", "rz").agg(F.min("rid").alias("rid"))
    axes = ["x", "y", "z"]
    refs = staged(refs.select("rid", F.lit(0).alias("rpid"), *[F.col(f"r{a}").alias(f"{side}_{a}") for a in axes for side in ("lo", "hi")]))
    turn = F.atan2("lo_y", "lo_x") / (2 * F.pi()) + 0.5
    n = refs.count()
    packed, nodes, levels = _packed(refs, axes, [turn, (F.col("lo_z") + 1) / 2], n)
    d2 = sum(((F.col(f"lo_{a}") - F.col(a)) ** 2 for a in axes[1:]), (F.col("lo_x") - F.col("x")) ** 2)
    at = locs.select(*KEYS, F.lit(0).alias("pid"), x.alias("x"), y.alias("y"), z.alias("z"))
    best = _descend(at, packed, nodes, levels, axes, d2, 2.0, KEYS)
    return counted(best.select(*KEYS, S.chord_metres(F.col("d2")).alias("metres"), "rid"), n)


def nearest_segments(locs: DataFrame, segs: DataFrame, lon0=None, lat0=None) -> DataFrame:
    """Rows (keys, metres, fid): planar distance to the nearest segment in the LAEA about a centre.

    With ``lon0`` and ``lat0`` all share a centre; else both sides carry pid, clon and clat
    and a location sees the segments of its own pid. Equal distances go to the lowest fid.
    Segments longer than the mean are indexed in pieces of that length (at most as many again
    as there are segments), which lead to the whole: one long segment loosens no other's box.
    """
    own = lon0 is None
    c = (F.col("clon"), F.col("clat")) if own else (float(lon0), float(lat0))
    x, y = S.laea_forward(F.col("lon"), F.col("lat"), *c)
    pid = [F.col("pid")] if own else [F.lit(0).alias("pid")]
    at = locs.select(*KEYS, *pid, x.alias("x"), y.alias("y"))
    (ax, ay), (bx, by) = S.laea_forward(F.col("alon"), F.col("alat"), *c), S.laea_forward(F.col("blon"), F.col("blat"), *c)
    ends = ["ax", "ay", "bx", "by"]
    refs = segs.select(F.col("fid").alias("rid"), *([F.col("pid").alias("rpid")] if own else [F.lit(0).alias("rpid")]), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    for e in ends:
        refs = refs.where(finite(F.col(e)))
    refs = staged(refs.groupBy("rpid", *ends).agg(F.min("rid").alias("rid")))
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n, mean = refs.agg(F.count("*"), F.avg(size)).first()
    piece = F.greatest(F.lit(1), F.ceil(size / F.lit(mean or 1.0))).cast("int") if mean else F.lit(1)
    refs = refs.withColumn("_m", piece).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    on = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("_m"))
    cut = {q: (on(f"a{q}", f"b{q}", F.col("_k")), on(f"a{q}", f"b{q}", F.col("_k") + 1)) for q in "xy"}
    refs = refs.select("rid", "rpid", *ends, *[f(*cut[q]).alias(f"{side}_{q}") for q in "xy" for side, f in (("lo", F.least), ("hi", F.greatest))])
    whole = 4 * S.AUTHALIC_RADIUS
    order = [(F.col(f"lo_{q}") + F.col(f"hi_{q}")) / (2 * whole) + 0.5 for q in "xy"]
    packed, nodes, levels = _packed(refs, ["x", "y"], order, 2 * n)
    d2 = S.segment_distance2(F.col("x"), F.col("y"), *map(F.col, ends))
    best = _descend(at, packed, nodes, levels, ["x", "y"], d2, whole, [*KEYS, "pid"])
    return counted(best.select(*KEYS, F.sqrt("d2").alias("metres"), F.col("rid").alias("fid")), n)


#: Cell sizes (degrees) for boxes: a feature is dealt at the smallest size that gives it few cells.
LEVELS = (1.0, 8.0, 64.0)


def _level(width: Column) -> Column:
    return F.when(width <= 8 * LEVELS[0], 0).when(width <= 8 * LEVELS[1], 1).otherwise(2)


#: Rows and columns of a polygon's grid at least and at most, columns of a bucket (a power of two), and degrees by which edges are thickened.
LEAST_GRID, MOST_GRID, BUCKET_BITS, THICK = 16, 4096, 5, 1e-9


def _gridded(features: DataFrame) -> DataFrame:
    """Rows (fid, ..., edge): the edges of each polygon with the grid over its bounds: x0, y0, cell width and height, number of columns and rows.

    There are about four times as many cells as edges, and no more rows than let an edge meet
    four of them on average, so that what the edges touch grows with their number.
    """
    e = G._pairs(features.select("fid", "xmin", "xmax", "ymin", "ymax", "rings"), True, ["fid", "xmin", "xmax", "ymin", "ymax"]).drop("ring", "seg")
    sums = e.groupBy("fid").agg(F.count("*").alias("_n"), F.sum(F.abs(F.col("blat") - F.col("alat"))).alias("_rise"))
    high = F.greatest(F.col("ymax") - F.col("ymin"), F.lit(THICK))
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.lit(THICK))
    between = lambda c: F.greatest(F.lit(LEAST_GRID), F.least(F.lit(MOST_GRID), F.ceil(c))).cast("int")
    rows = between(F.least(2 * F.sqrt("_n"), 4 * F.col("_n") * high / F.greatest(F.col("_rise"), F.lit(THICK))))
    both = e.join(sums, "fid").withColumns({"rows": rows, "columns": between(2 * F.sqrt("_n"))})
    return both.select("fid", F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), (wide / F.col("columns")).alias("cw"), (high / F.col("rows")).alias("ch"), "columns", "rows", "alon", "alat", "blon", "blat")


def _cell(c: Column, low: str, size: str, n: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor((c - F.col(low)) / F.col(size)).cast("int")))


def _touched(edges: DataFrame) -> DataFrame:
    """Rows (fid, j, first, last, run, ...): the columns of row j that an edge touches, and the run of touched columns they belong to."""
    low, high = F.least("alat", "blat") - THICK, F.greatest("alat", "blat") + THICK
    rows = edges.withColumn("j", F.explode(F.sequence(_cell(low, "y0", "ch", "rows"), _cell(high, "y0", "ch", "rows"))))
    # the part of the edge inside the row; all of one that is flat within the thickness
    rise = F.col("blat") - F.col("alat")
    at = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("alat")) / F.when(F.abs(rise) > THICK, rise)))
    bottom = F.col("y0") + F.col("j") * F.col("ch")
    x = [F.when(F.abs(rise) > THICK, F.col("alon") + at(y) * (F.col("blon") - F.col("alon"))).otherwise(F.col(whole)) for y, whole in ((bottom - THICK, "alon"), (bottom + F.col("ch") + THICK, "blon"))]
    rows = rows.withColumns({"first": _cell(F.least(*x) - THICK, "x0", "cw", "columns"), "last": _cell(F.greatest(*x) + THICK, "x0", "cw", "columns")})
    w = Window.partitionBy("fid", "j").orderBy("first", "last")
    new = F.col("first") > F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(-1))
    return rows.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cover(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grids, stretches, edges) of polygons: where each lies wholly inside its grid's cells, and where edges must be asked.

    Grids: (fid, x0, y0, cw, ch, columns, rows). Stretches: (fid, j, bucket, first, last, run,
    odd): columns first to last of row j; without a run they are wholly inside, with one they
    are touched by its edges, and ``odd`` tells whether the untouched cells to their right
    are inside. Columns in no stretch are outside. Edges: (fid, j, run, alon, alat, blon, blat).
    """
    touched = staged(_touched(_gridded(features.where("xmin is not null").dropDuplicates(["fid"]))))
    grids = touched.select("fid", "x0", "y0", "cw", "ch", "columns", "rows").distinct()
    middle = F.col("y0") + (F.col("j") + 0.5) * F.col("ch")
    crossing = (F.col("alat") > middle) != (F.col("blat") > middle)
    runs = touched.groupBy("fid", "j", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count_if(crossing).alias("_n"))
    w = Window.partitionBy("fid", "j").orderBy(F.col("run").desc())
    beyond = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"odd": beyond % 2 == 1, "_next": F.lag("first").over(w)})
    inside = F.when(F.col("odd") & (F.col("_next") > F.col("last") + 1), F.struct((F.col("last") + 1).alias("first"), (F.col("_next") - 1).alias("last"), F.lit(None).cast("long").alias("run")))
    both = F.array_compact(F.array(F.struct("first", "last", F.col("run").cast("long").alias("run")), inside))
    stretches = runs.select("fid", "j", "odd", F.explode(both).alias("s")).select("fid", "j", "odd", "s.*")
    bucket = F.explode(F.sequence(F.shiftright("first", BUCKET_BITS), F.shiftright("last", BUCKET_BITS)))
    return grids, stretches.withColumn("bucket", bucket), touched.where("alat <> blat").select("fid", "j", F.col("run").cast("long").alias("run"), "alon", "alat", "blon", "blat")


def inside(locs: DataFrame, features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (keys, fid): every polygon a location lies in, by bounds, then cover, then even-odd.

    Bounds meet on an equi-join of cells (three sizes, so that neither an islet nor an
    ocean has many). A location in an untouched cell of the polygon's grid is answered by
    the cell; in a touched one, only the edges of its run of touched cells are asked, the
    parity of all others being that of the cells to the right: so neither the interior nor
    a far part of a jagged coast costs an edge test, and the answer is that of all edges.
    ``by``: columns both sides share that must agree as well.
    """
    by = by or []
    whole = features.where("xmin is not null").dropDuplicates([*by, "fid"])
    boxes = whole.select(*by, "fid", "xmin", "xmax", "ymin", "ymax").withColumn("level", _level(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))))
    size = F.element_at(F.array(*[F.lit(s) for s in LEVELS]), F.col("level") + 1)
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    boxes = boxes.withColumn("_i", F.explode(span("xmin", "xmax"))).withColumn("_j", F.explode(span("ymin", "ymax"))).withColumn("_cell", F.struct("level", "_i", "_j"))
    cells = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("lon") / s).alias("_i"), F.floor(F.col("lat") / s).alias("_j")) for k, s in enumerate(LEVELS)])
    at = locs.select(*KEYS, *by, "lon", "lat").withColumn("_cell", F.explode(cells))
    within = (F.col("lon") >= F.col("xmin")) & (F.col("lon") <= F.col("xmax")) & (F.col("lat") >= F.col("ymin")) & (F.col("lat") <= F.col("ymax"))
    grids, stretches, edges = cover(features)
    candidates = at.join(boxes, ["_cell", *by]).where(within).select(*KEYS, "lon", "lat", "fid").join(grids, "fid")
    candidates = candidates.select(*KEYS, "lon", "lat", "fid", _cell(F.col("lat"), "y0", "ch", "rows").alias("j"), _cell(F.col("lon"), "x0", "cw", "columns").alias("_c"))
    found = candidates.withColumn("bucket", F.shiftright("_c", BUCKET_BITS)).join(stretches, ["fid", "j", "bucket"]).where("_c between first and last")
    sure = found.where("run is null").select(*KEYS, "fid")
    # an edge runs from vertex j (its start) to vertex i (its end)
    crosses = S.edge_crosses(F.col("lon"), F.col("lat"), F.col("blon"), F.col("blat"), F.col("alon"), F.col("alat"))
    asked = found.where("run is not null").select(*KEYS, "lon", "lat", "fid", "j", "run", "odd").join(edges, ["fid", "j", "run"], "left")
    n = F.count_if(crosses) + F.max(F.col("odd").cast("int"))
    return sure.union(asked.groupBy(*KEYS, "fid").agg(n.alias("_n")).where("_n % 2 = 1").select(*KEYS, "fid"))


def containing(locs: DataFrame, features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (keys, fid): the lowest fid of the polygons a location lies in; see :func:`inside`."""
    return inside(locs, features, by).groupBy(*KEYS).agg(F.min("fid").alias("fid"))


def locate(locs: DataFrame, features: DataFrame, lon0=None, lat0=None) -> DataFrame:
    """Rows (keys, fid, metres): the polygon a location lies in (0 metres), else the nearest boundary's."""
    own = lon0 is None
    held = staged(containing(locs, features, ["pid"] if own else None).withColumn("metres", F.lit(0.0)))
    rest = locs.join(held.select(*KEYS), KEYS, "left_anti")
    segs = G.segments(features) if not own else G._pairs(features, False, ["fid", "pid", "clon", "clat"])
    near = nearest_segments(rest, segs, lon0, lat0)
    return counted(held.select(*KEYS, "fid", "metres").union(near.select(*KEYS, "fid", "metres")), near.n_references)


#: Tiles up to which a grid is told which ones to read; beyond, it is read between bounds.
MOST_TILES = 4096


def grid_lookup(locs: DataFrame, grid: DataFrame, lat_axis: tuple[float, float, int], lon_axis: tuple[float, float, int]) -> DataFrame:
    """Rows (keys, elevation): the value of the nearest cell of a regular grid (i, j, elevation); axes are (origin, step, length).

    Longitudes are wrapped to [-180, 180). Locations are the small side: they are what may
    be broadcast or shuffled. A grid with a column ``tile`` (:func:`S.tile`) is asked for the
    tiles that hold a location, however far apart: their number is checked, and a Parquet
    table partitioned by tile or a NetCDF file reads those alone. Any other is scanned once,
    between the lowest and highest cells asked for.
    """
    i = S.axis_index(F.col("lat"), *lat_axis)
    j = S.axis_index(S.normalize_lon(F.col("lon")), *lon_axis)
    at = staged(locs.select(*KEYS, i.alias("i"), j.alias("j")).where("i is not null and j is not null").withColumn("tile", S.tile(F.col("i"), F.col("j"))))
    tiled, some = "tile" in grid.columns, []
    if tiled:
        some = [r[0] for r in at.select("tile").distinct().limit(MOST_TILES + 1).collect()]
    if tiled and len(some) <= MOST_TILES:
        grid = grid.where(F.col("tile").isin(some))
    else:
        ends = at.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
        if ends[0] is not None:
            grid = grid.where(F.col("i").between(*ends[:2]) & F.col("j").between(*ends[2:]))
    on = [*(["tile"] if tiled else []), "i", "j"]
    cells = grid.select(*(["tile"] if tiled else []), F.col("i").cast("int"), F.col("j").cast("int"), F.col("elevation").cast("double"))
    return at.join(cells, on).select(*KEYS, "elevation")

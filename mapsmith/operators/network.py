"""Line networks: ends, connections, dead ends, contiguous lines, merging and splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapsmith.functions import geometry as g
from mapsmith.operators.components import components
from mapsmith.operators.model import ord_part, ord_under
from mapsmith.operators.points import near_pairs
from mapsmith.operators.spatial import by_reach, explode_parts, inherit_first, labels, meeting, semi, sjoin, topological_points
from mapsmith.plans.cutting import cut


def endpoints(lines: DataFrame) -> DataFrame:
    """(_ord, fid, part, side, x, y, n): both ends of each part; n: ends at that place, to five decimals."""
    part = lines.select("_ord", "fid", F.posexplode(g.dump("geom")).alias("part", "_g"))
    both = part.select("_ord", "fid", "part", F.posexplode(F.array(g.start_of("_g"), g.end_of("_g"))).alias("side", "_p"))
    at = both.select("_ord", "fid", "part", "side", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))
    return at.withColumn("n", F.count("*").over(Window.partitionBy(F.round("x", 5), F.round("y", 5))))


def remove_disconnected_short(lines: DataFrame, length: float) -> DataFrame:
    """Lines of that length stay, and those of which two end places are shared with others."""
    places = endpoints(lines).select("_ord", "x", "y").distinct()
    shared = places.withColumn("_n", F.count("*").over(Window.partitionBy("x", "y"))).where("_n > 1").groupBy("_ord").agg(F.count("*").alias("_k"))
    return lines.join(shared, "_ord", "left").where((g.length("geom") >= length) | (F.coalesce("_k", F.lit(0)) >= 2)).select(lines.columns)


def connect_near_ends(lines: DataFrame, gap: float) -> DataFrame:
    """``lines`` and a straight helper from each lone end to the nearest other end nearer than ``gap``."""
    ends = endpoints(lines).withColumn("id", F.struct("_ord", "part", "side"))
    lone, every = ends.where("n = 1").select("id", "x", "y", "fid"), ends.select("id", "x", "y")
    met = near_pairs(lone, gap, strict=True, others=every).where("a_id != b_id")
    best = met.groupBy("a_id").agg(F.min_by(F.struct("a_x", "a_y", "b_x", "b_y", "a_fid"), F.struct("d", "b_id")).alias("p"))
    at = lambda n: F.array(F.col(f"p.{n}_x"), F.col(f"p.{n}_y"))
    new = best.select(F.concat(F.lit("gap:"), "p.a_fid", F.lit(":"), F.col("a_id.side").cast("string")).alias("fid"), g.line(F.array(at("a"), at("b"))).alias("geom"), ord_part("a_id.side", ord_under(1, ord_part("a_id.part", "a_id._ord"))).alias("_ord"))
    return lines.withColumn("_ord", ord_under(0)).unionByName(new, allowMissingColumns=True)


def end_touches(lines: DataFrame, others: DataFrame, distance: float = 0.0, *, itself: bool = False) -> DataFrame:
    """``lines`` with first_intersects and last_intersects: whether each end comes within ``distance`` of another
    row of ``others`` (``itself``: of any row, as the tables differ) (N4 to N7, N9, N10)."""
    both = lines.select("_ord", F.posexplode(F.array(g.start_of("geom"), g.end_of("geom"))).alias("side", "p"))
    at = both.select("_ord", "side", g.point(F.col("p")[0], F.col("p")[1]).alias("geom"))
    met = sjoin(at, others.select("geom") if itself else others.select("_ord", "geom"), "dwithin", distance=distance)
    if not itself:
        met = met.where("l._ord != r._ord")
    by = met.groupBy(F.col("l._ord").alias("_ord")).agg(F.max((F.col("l.side") == 0).cast("int")).alias("_a"), F.max((F.col("l.side") == 1).cast("int")).alias("_b"))
    out = lines.join(by, "_ord", "left")
    return out.withColumn("first_intersects", F.coalesce(F.col("_a") == 1, F.lit(False))).withColumn("last_intersects", F.coalesce(F.col("_b") == 1, F.lit(False))).drop("_a", "_b")


def check_connections(lines: DataFrame, distance: float, column: str) -> tuple[DataFrame, DataFrame]:
    """Lines with an end near another line, and the others."""
    out = end_touches(lines, lines, distance).withColumn(column, F.col("first_intersects") | F.col("last_intersects")).drop("first_intersects", "last_intersects")
    return out.where(column), out.where(~F.col(column))


def all_of(tables: list[DataFrame]) -> DataFrame:
    """The geometries of all tables."""
    every = tables[0].select("geom")
    for t in tables[1:]:
        every = every.unionByName(t.select("geom"))
    return every


def check_reference_connections(lines: DataFrame, distance: float, references: list[DataFrame], column: str) -> tuple[DataFrame, DataFrame]:
    """The same against reference tables."""
    out = end_touches(lines, all_of(references), distance, itself=True).withColumn(column, F.col("first_intersects") | F.col("last_intersects")).drop("first_intersects", "last_intersects")
    return out.where(column), out.where(~F.col(column))


def dead_ends(lines: DataFrame, distance: float, column: str) -> tuple[DataFrame, DataFrame]:
    """Lines with both ends or none connected, and those with exactly one."""
    out = end_touches(lines, lines, distance).withColumn(column, F.col("first_intersects") != F.col("last_intersects"))
    return out.where(~F.col(column)), out.where(column)


def free_ends_at_reference(dead: DataFrame, distance: float, references: list[DataFrame], column: str) -> DataFrame:
    """Whether the end of a dead end that no line touches comes near a reference."""
    there = end_touches(dead.drop("first_intersects", "last_intersects"), all_of(references), distance, itself=True).select("_ord", F.col("first_intersects").alias("_f"), F.col("last_intersects").alias("_l"))
    free = F.when(F.col("first_intersects"), F.col("_l")).otherwise(F.col("_f"))
    return dead.join(there, "_ord").withColumn(column, free).drop("_f", "_l")


def flag_connections(lines: DataFrame, reference: DataFrame | None = None, *, start: str = "start_connected", end: str = "end_connected") -> DataFrame:
    """Whether each end meets another row, or the reference."""
    out = end_touches(lines, lines if reference is None else reference, itself=reference is not None)
    return out.withColumnsRenamed({"first_intersects": start, "last_intersects": end})


def count_connections(lines: DataFrame, *, start: str = "start_count", end: str = "end_count") -> DataFrame:
    """How many other rows meet each end."""
    both = lines.select("_ord", F.posexplode(F.array(g.start_of("geom"), g.end_of("geom"))).alias("side", "p"))
    at = both.select("_ord", "side", g.point(F.col("p")[0], F.col("p")[1]).alias("geom"))
    met = sjoin(at, lines.select("_ord", "geom")).where("l._ord != r._ord")
    by = met.groupBy(F.col("l._ord").alias("_ord")).agg(F.count(F.when(F.col("l.side") == 0, 1)).alias(start), F.count(F.when(F.col("l.side") == 1, 1)).alias(end))
    return lines.join(by, "_ord", "left").fillna(0, [start, end])


def graph_edges(lines: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(src, dst, length, ...) of the simple graph of line ends to three decimals: of parallel edges the last row
    stays (N17)."""
    node = lambda p: F.concat_ws(" ", F.round(p[0], 3).cast("string"), F.round(p[1], 3).cast("string"))
    rows = lines.withColumns({"src": node(g.start_of("geom")), "dst": node(g.end_of("geom")), "length": g.length("geom")})
    last = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.desc("_ord"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("src", "dst", "_ord", "fid", "length", "geom", *(extra or []))


def cluster_graph(edges: DataFrame, longest: float) -> DataFrame:
    """(node, component) over edges shorter than ``longest``."""
    short = edges.where(F.col("length") < longest)
    return components(short, "src", "dst")


def chains(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``lines`` with _comp: rows that a line merge joins, end to end over places where just two ends meet."""
    keys = by or []
    ends = endpoints(lines).select("_ord", "x", "y").join(lines.select("_ord", *keys), "_ord")
    safe = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, c in enumerate(keys)]
    at = ends.select("_ord", "x", "y", *safe).groupBy("x", "y", *[f"_k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"), F.min("_ord").alias("a"), F.max("_ord").alias("b"))
    return labels(lines, at.where("n = 2 AND a != b").select("a", "b"))


def merge_by_attribute(lines: DataFrame, attribute: str, old_ids: str = "old_ids") -> DataFrame:
    """Lines of equal attribute (null is a value too) merged end to end, with the merged ids, and the attributes of
    the first row that they meet (G4)."""
    grouped = chains(lines, [attribute])
    by = grouped.groupBy("_comp").agg(g.call("merge", g.call("collect", F.collect_list("geom"))).alias("geom"), F.array_sort(F.collect_list("fid")).alias(old_ids), F.min("_ord").alias("_ord"), F.min_by("fid", "_ord").alias("fid"))
    merged = explode_parts(by.select("fid", "geom", "_ord", old_ids))
    out = inherit_first(lines, merged.select("fid", "_ord", "geom"))
    return out.join(merged.select("_ord", old_ids), "_ord").withColumn("fid", F.when(F.size(old_ids) > 1, F.col("fid")).otherwise(F.element_at(old_ids, 1)))


def contiguous(lines: DataFrame, reference: DataFrame | None = None, *, length: str = "contiguous_length", dead: str = "dead_end", apart: str = "disconnected") -> DataFrame:
    """Each row with the length of the merged line that it is part of, and whether just one end of that line, or
    none, meets another merged line or the reference (N13)."""
    grouped = cut(chains(lines), "chains")
    size = grouped.groupBy("_comp").agg(F.sum(g.length("geom")).alias(length), g.call("merge", g.call("collect", F.collect_list("geom"))).alias("geom"), F.min("_ord").alias("_ord"))
    whole = explode_parts(size.select(F.col("_comp").cast("string").alias("fid"), "geom", "_ord", "_comp", length))
    met = end_touches(whole, whole)
    if reference is not None:
        there = end_touches(whole, reference, itself=True).select("_ord", F.col("first_intersects").alias("_f"), F.col("last_intersects").alias("_l"))
        met = met.join(there, "_ord").withColumn("first_intersects", F.col("first_intersects") | F.col("_f")).withColumn("last_intersects", F.col("last_intersects") | F.col("_l"))
    ring = F.element_at(g.vertices("geom"), 1) == F.element_at(g.vertices("geom"), -1)
    flags = met.select("_comp", (~ring & (F.col("first_intersects") != F.col("last_intersects"))).alias(dead), (~F.col("first_intersects") & ~F.col("last_intersects")).alias(apart))
    flags = flags.groupBy("_comp").agg(F.max(dead).alias(dead), F.max(apart).alias(apart))
    return grouped.join(size.select("_comp", length), "_comp").join(flags, "_comp", "left").drop("_comp").fillna(False, [dead, apart])


def split_by_points(lines: DataFrame, points: DataFrame, reach: float = 1.0) -> DataFrame:
    """Lines cut where a point nearer than ``reach`` projects on them; ids repeat."""
    met = sjoin(lines.select("_ord", "geom"), points.select("geom"), "dwithin", distance=reach, strict=True)
    by = met.groupBy(F.col("l._ord").alias("_ord")).agg(F.array_sort(F.collect_set(g.call("project", "l.geom", "r.geom"))).alias("_d"))
    out = lines.join(by, "_ord", "left").withColumn("_n", g.length("geom"))
    inner = F.filter(F.coalesce("_d", F.array().cast("array<double>")), lambda d: (d > 0) & (d < F.col("_n")))
    bounds = F.concat(F.array(F.lit(0.0)), inner, F.array(F.col("_n")))
    spans = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.struct(F.element_at(bounds, i).alias("a"), F.element_at(bounds, i + 1).alias("b")))
    piece = F.when(F.size(inner) == 0, F.col("geom")).otherwise(g.call("substring", "geom", "_s.a", "_s.b"))
    cut_up = out.withColumn("_bounds", spans).select("*", F.posexplode("_bounds").alias("_k", "_s"))
    return cut_up.select(*[piece.alias("geom") if c == "geom" else ord_part("_k").alias("_ord") if c == "_ord" else F.col(c) for c in lines.columns])


def extend_to(line: str, target: str, at_start: Column, at_end: Column, tolerance: float = 0.0) -> Column:
    """The shortest connector from each wanted end to ``target`` appended; longer than a positive tolerance, it is
    left out (S16)."""
    v = g.vertices(line)
    reach = lambda p: g.vertices(g.call("shortest", g.line(F.array(p)), target))
    near = lambda p: F.lit(True) if tolerance <= 0 else g.distance(g.line(F.array(p)), target) <= tolerance
    first, last = F.element_at(v, 1), F.element_at(v, -1)
    moved = lambda p: g.distance(g.line(F.array(p)), target) > 0
    before = F.when(at_start & near(first) & moved(first), F.array(F.element_at(reach(first), 2)))
    after = F.when(at_end & near(last) & moved(last), F.array(F.element_at(reach(last), 2)))
    none = F.array().cast("array<array<double>>")
    return g.line(F.concat(F.coalesce(before, none), v, F.coalesce(after, none)))


def reconnect(lines: DataFrame, process: Callable[[DataFrame], DataFrame], to: DataFrame, *, tolerance: float = 0.0) -> DataFrame:
    """``process(lines)``, where an end that lost connections is led on to the nearest line of ``to``; of rows that
    end at one place the first is led on (N12)."""
    before = count_connections(lines, start="_s0", end="_e0").select("fid", "_s0", "_e0", F.col("geom").alias("_old"))
    after = explode_parts(process(lines))
    counted = count_connections(after, start="_s1", end="_e1").join(before, "fid", "left")
    lost = lambda end, k: (F.col(f"_{k}0") > F.col(f"_{k}1")) | ((g.distance(end, "_old") <= 0.1) & (g.distance(end, g.boundary("_old")) > 1e-9))
    p, q = g.line(F.array(g.start_of("geom"))), g.line(F.array(g.end_of("geom")))
    flagged = counted.withColumns({"_ls": F.coalesce(lost(p, "s"), F.lit(False)), "_le": F.coalesce(lost(q, "e"), F.lit(False))})
    events = flagged.select("_ord", F.posexplode(F.array(F.struct(F.col("_ls").alias("on"), g.start_of("geom").alias("p")), F.struct(F.col("_le").alias("on"), g.end_of("geom").alias("p")))).alias("side", "e")).where("e.on")
    first = events.withColumn("_r", F.row_number().over(Window.partitionBy(F.col("e.p")[0], F.col("e.p")[1]).orderBy("_ord", "side"))).where("_r = 1")
    wanted = first.groupBy("_ord").agg(F.max((F.col("side") == 0).cast("int")).alias("_ws"), F.max((F.col("side") == 1).cast("int")).alias("_we"))
    ready = flagged.join(wanted, "_ord", "left")
    out = extend_flagged(ready, to, F.coalesce(F.col("_ws") == 1, F.lit(False)), F.coalesce(F.col("_we") == 1, F.lit(False)), tolerance)
    return out.select(after.columns)


def extend_flagged(lines: DataFrame, to: DataFrame, start: Column, end: Column, tolerance: float = 0.0) -> DataFrame:
    """Lines led on, at the ends that the two conditions say, to the nearest row of ``to``: up to a positive
    ``tolerance``, or else however far (S16)."""
    ready = cut(lines.withColumns({"_ws": start.cast("int"), "_we": end.cast("int")}), "lost-ends")
    ends = ready.where("_ws = 1 OR _we = 1").select("_ord", F.explode(F.array(F.when(F.col("_ws") == 1, F.array(g.start_of("geom"))), F.when(F.col("_we") == 1, F.array(g.end_of("geom"))))).alias("p"))
    ends = ends.where("p IS NOT NULL").select(ord_part(F.monotonically_increasing_id()).alias("_ord"), g.line("p").alias("geom"))
    ends = cut(ends, "ends")
    if tolerance > 0:
        met = sjoin(ends, to.select("geom"), "dwithin", distance=tolerance).select(F.col("l._ord").alias("_ord"), F.col("r.geom").alias("_to"))
    else:  # the nearest one, however far
        start = ends.agg(F.max(F.abs(g.call("envelope", "geom")[0]))).head()[0]
        met = by_reach(ends, to, max(1.0, (start or 0.0) / 1e6)).select("_ord", F.explode("_to").alias("_to"))
    whose = met.select(F.slice("_ord", 1, F.size("_ord") - 1).alias("_ord"), "_to")
    out = ready.join(whose.groupBy("_ord").agg(g.call("collect", F.collect_set("_to")).alias("_to")), "_ord", "left")
    geom = F.when(F.col("_to").isNotNull(), extend_to("geom", "_to", F.col("_ws") == 1, F.col("_we") == 1, tolerance)).otherwise(F.col("geom"))
    return out.withColumn("geom", geom).select(lines.columns)


def faces(lines: DataFrame) -> DataFrame:
    """(fid, geom, _ord): the faces of each connected network, inner ones dissolved, each with an id of its own
    (N21)."""
    grouped = cut(meeting(lines), "networks")
    areas = grouped.groupBy("_comp").agg(g.call("faces", F.array_sort(F.collect_list("geom"))).alias("_f"))
    parts = areas.select("_comp", F.posexplode(g.dump(g.union("_f"))).alias("_k", "geom"))
    own = parts.select(ord_part("_k", "_comp").alias("_ord"), "geom")
    return cut(own.select(F.concat_ws(":", F.transform("_ord", lambda k: k.cast("string"))).alias("fid"), "geom", "_ord"), "faces")


def prune_to_fixpoint(lines: DataFrame, kind: str, value: str) -> DataFrame:
    """Rows of one kind without a connected end go, until none is left, however many rounds that takes."""
    now = cut(lines, "prune")
    n = now.count()
    while True:
        met = end_touches(now, now)
        keep = (F.coalesce(F.col(kind), F.lit("")) != value) | (F.col("first_intersects") & F.col("last_intersects"))
        now = cut(met.where(keep).select(lines.columns), "prune")
        if (left := now.count()) == n:
            return now
        n = left


def joints_of(lines: DataFrame) -> DataFrame:
    """(_ord, geom, a, b): the places where just two rows meet, as points, and these rows."""
    at = topological_points(lines).where("n = 2").select(F.array(F.monotonically_increasing_id()).alias("_ord"), g.point(F.col("x"), F.col("y")).alias("geom"))
    at = cut(at, "joints")
    met = sjoin(at, lines.select("_ord", "geom")).groupBy(F.col("l._ord").alias("_ord"), F.col("l.geom").alias("geom"))
    return met.agg(F.min("r._ord").alias("a"), F.max("r._ord").alias("b"))


def smooth_connections(lines: DataFrame, *, distance: float = 30.0, subdivisions: int = 10) -> DataFrame:
    """Lines with a curve through each place where just two of them end (N15, S39). Joints of one chain of lines see
    each other's result, in the order of their places."""
    if distance <= 0 or subdivisions < 1:
        raise ValueError("distance and subdivisions must be positive")
    lines = cut(lines, "lines")
    joints = cut(joints_of(lines), "joints")
    grouped = labels(lines.select("_ord", "geom"), joints.where("a != b").select("a", "b"))
    comp = grouped.select(F.col("_ord").alias("a"), "_comp")
    v = F.element_at(g.vertices("geom"), 1)
    places = joints.join(comp, "a").groupBy("_comp").agg(F.array_sort(F.collect_list(F.struct(v[0].alias("x"), v[1].alias("y"), "geom"))).alias("_j"))
    chains_ = grouped.join(places, "_comp").groupBy("_comp").agg(F.array_sort(F.collect_list(F.struct("_ord", "geom"))).alias("_l"), F.first("_j").alias("_j"))
    curved = chains_.select(F.explode(F.arrays_zip(F.col("_l._ord").alias("o"), g.call("smoothjoints", "_l.geom", "_j.geom", F.lit(float(distance)), F.lit(subdivisions)).alias("g"))).alias("r"))
    out = lines.join(curved.select(F.col("r.o").alias("_ord"), F.col("r.g").alias("_g")), "_ord", "left")
    return out.withColumn("geom", F.coalesce("_g", "geom")).select(lines.columns)


def flag_centre_connections(lines: DataFrame, reference: DataFrame, polygon: str, *, around: float = 50.0, start: str = "start_connected", end: str = "end_connected") -> DataFrame:
    """Centre lines with whether their polygon (column ``polygon``), within ``around`` of each end, meets the
    reference (N11)."""
    both = lines.select("_ord", F.posexplode(F.array(g.start_of("geom"), g.end_of("geom"))).alias("side", "p"), F.col(polygon).alias("_poly"))
    near = both.select("_ord", "side", g.intersection("_poly", g.buffer(g.line(F.array("p")), around)).alias("geom")).where(~g.is_empty("geom"))
    met = semi(near, reference).groupBy("_ord").agg(F.max(F.col("side") == 0).alias("_a"), F.max(F.col("side") == 1).alias("_b"))
    out = lines.join(met, "_ord", "left").withColumns({start: F.coalesce("_a", F.lit(False)), end: F.coalesce("_b", F.lit(False))})
    return out.select(*[c for c in lines.columns if c not in (start, end)], start, end)

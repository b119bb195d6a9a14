"""Channel networks: stream order, junctions, basins, and what is picked from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catena.operators import flow
from catena.storage import store


def channel_nodes(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes at or below a source: those that at least one source drains to."""
    marked = nodes.join(sources.select("node", F.lit(1).alias("__s")), "node", "left").fillna(0, ["__s"])
    below = flow.accumulate(marked, {}, {"has": F.col("__s")}).where("has = 1").select("node")
    return nodes.join(below, "node", "left_semi")


def strahler(channel: DataFrame) -> DataFrame:
    """``node, stream_order`` of a channel tree (node, receiver).

    Chains between junctions have one order, so the tree is first shrunk to sources and
    junctions by pointer jumps; rounds then climb the shrunken tree, one for each level.  A round hands the orders that are new to the
    junctions below, which keep how many came and the two highest; only new orders and waiting junctions are written.
    """
    feeds = channel.where("node <> receiver").groupBy(F.col("receiver").alias("node")).agg(F.count("*").alias("n"))
    kind = store(channel.select("node", "receiver").join(feeds, "node", "left").fillna(0, ["n"]), "channel-kinds")
    # Going up from a node with one donor ends at a source or a junction.
    single = kind.where("n <> 1").select("node")
    above = channel.where("node <> receiver").select(F.col("receiver").alias("node"), F.col("node").alias("donor"))
    chain = kind.where("n = 1").select("node").join(above, "node").select("node", F.col("donor").alias("receiver")).unionByName(single.select("node", F.col("node").alias("receiver")))
    head = store(flow.to_root(chain).select("node", F.col("root").alias("head")), "chain-heads")
    # The shrunken tree: the heads of a junction's donors.
    links = kind.where("n > 1").select("node").join(above, "node").join(head.select(F.col("node").alias("donor"), F.col("head").alias("from")), "donor").select(F.col("node").alias("to"), "from")
    links = store(links, "links")
    done = [store(kind.where("n = 0").select("node", F.lit(1).alias("stream_order")), "order-0")]
    left = store(links.groupBy("to").agg(F.count("*").alias("need")).select("to", "need", F.lit(0).cast("long").alias("have"), F.lit(0).alias("first"), F.lit(0).alias("second")), "need-0")
    while left.take(1):
        got = links.join(done[-1].withColumnRenamed("node", "from"), "from").groupBy("to").agg(F.count("*").alias("more"), F.collect_list("stream_order").alias("all"))
        # A junction of a grid has at most eight donors, so its list is short.
        two = F.slice(F.sort_array(F.concat(F.array("first", "second"), F.coalesce("all", F.array().cast("array<int>"))), asc=False), 1, 2)
        now = left.join(got, "to", "left").select("to", "need", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have"), two[0].alias("first"), two[1].alias("second"))
        now = store(now, f"need-{len(done)}")
        # Two or more donors of the highest order make one more.
        order = F.col("first") + F.when(F.col("first") == F.col("second"), 1).otherwise(0)
        done.append(store(now.where("need = have").select(F.col("to").alias("node"), order.cast("int").alias("stream_order")), f"order-{len(done)}"))
        left = now.where("need > have")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return head.join(every.withColumnRenamed("node", "head"), "head").select("node", "stream_order")


def junctions(channel: DataFrame, orders: DataFrame) -> DataFrame:
    """Sources, confluences and roots of the channel tree: ``junction, n_donors, stream_order``."""
    d = flow.donors(channel)
    ends = channel.where("node = receiver").select("node", F.lit(True).alias("__root"))
    found = d.join(ends, "node", "left").where((F.col("n_donors") != 1) | F.col("__root"))
    return found.join(orders, "node").select(F.col("node").alias("junction"), "n_donors", "stream_order")


def junction_receivers(channel: DataFrame, found: DataFrame) -> DataFrame:
    """``junction, receiver_junction, distance``: the next junction downstream (a root: itself)."""
    mine = found.select(F.col("junction").alias("node"))
    # Every junction looks from its receiver on, where pointers stop at junctions.
    stop = flow.nearest_tag(channel, mine.withColumn("tag", F.col("node")))
    ahead = channel.join(mine, "node", "left_semi").select(F.col("node").alias("junction"), F.col("receiver").alias("node"), "dx")
    return ahead.join(stop, "node").select("junction", F.col("tag_node").alias("receiver_junction"), (F.col("dx") + F.col("distance")).alias("distance"))


def next_order(channel: DataFrame, orders: DataFrame) -> DataFrame:
    """``node, next_node``: the first node downstream of a higher order; nodes of the highest order on their way are left out."""
    o = orders.select("node", "stream_order")
    j = channel.select("node", "receiver").join(o, "node").join(o.select(F.col("node").alias("receiver"), F.col("stream_order").alias("__r")), "receiver")
    # Pointers run along nodes of one order; the last of them stands before the next order.
    stay = j.select("node", F.when(F.col("__r") > F.col("stream_order"), F.col("node")).otherwise(F.col("receiver")).alias("receiver"))
    last = flow.to_root(stay).select("node", F.col("root").alias("last"))
    ahead = j.where(F.col("__r") > F.col("stream_order")).select(F.col("node").alias("last"), F.col("receiver").alias("next_node"))
    return last.join(ahead, "last").select("node", "next_node")


def stream_counts(channel: DataFrame, orders: DataFrame) -> DataFrame:
    """``stream_order, n_streams``: a stream begins where no donor has its order."""
    o = orders.join(channel.select("node", "receiver"), "node")
    same = o.select(F.col("receiver").alias("node"), F.col("stream_order").alias("o"), F.col("node").alias("d")).where("node <> d")
    fed = orders.join(same, "node").where("stream_order = o").select("node").distinct()
    return orders.join(fed, "node", "left_anti").groupBy("stream_order").agg(F.count("*").alias("n_streams"))


def basins(nodes: DataFrame, outlets: DataFrame) -> DataFrame:
    """``node, basin`` by the nearest outlet (node) downstream: nested basins are cut out of larger ones."""
    return flow.nearest_tag(nodes, outlets.select("node", F.col("node").alias("tag"))).select("node", F.col("tag").alias("basin"))


def prune_by_size(counts: DataFrame, low: int, high: int) -> DataFrame:
    """Outlets with a number of contributing nodes in the window."""
    return counts.where(F.col("n_contrib").between(low, high))


def prune_nested(nodes: DataFrame, outlets: DataFrame) -> DataFrame:
    """Outlets with no other outlet downstream of them."""
    below = nodes.join(outlets.select("node"), "node", "left_semi").where("node <> receiver").select(F.col("node").alias("outlet"), F.col("receiver").alias("node"))
    nested = below.join(flow.nearest_tag(nodes, outlets.select("node", F.col("node").alias("tag"))), "node").select(F.col("outlet").alias("node"))
    return outlets.join(nested, "node", "left_anti")


def prune_edge(nodes: DataFrame, outlets: DataFrame, touched: DataFrame) -> DataFrame:
    """Outlets whose basins don't hold any of the touched nodes."""
    return outlets.join(touched.select("node"), "node", "left_anti")


def largest(counts: DataFrame, by: Column) -> DataFrame:
    """The one row with the largest value; of equal ones the smallest node."""
    return counts.orderBy(by.desc(), "node").limit(1)


def source_keys(channel: DataFrame, sources: DataFrame) -> DataFrame:
    """``node, source_key``: each node belongs to the source above it that is farthest from the root; ties go to the smaller one.

    Distances count to six places, so that the order in which steps were added does not decide.
    """
    far = flow.distance_from_outlet(channel).select("node", F.round("distance", 6).alias("distance"))
    s = sources.select("node").join(far, "node").select("node", F.struct(F.col("distance").alias("d"), (-F.col("node")).alias("minus")).alias("__s"))
    top = flow.accumulate(channel.join(s, "node", "left"), {}, {"top": F.col("__s")})
    return top.select("node", (-F.col("top.minus")).alias("source_key"))


def to_channel(nodes: DataFrame, channel: DataFrame, heights: DataFrame) -> DataFrame:
    """``node, channel_node, distance, relief``: the first channel node downstream, the way there, and the height above it."""
    near = flow.nearest_tag(nodes, channel.select("node", F.lit(1).alias("tag"))).drop("tag")
    z = heights.select("node", "z")
    return near.join(z, "node").join(z.select(F.col("node").alias("tag_node"), F.col("z").alias("zc")), "tag_node").select("node", F.col("tag_node").alias("channel_node"), "distance", (F.col("z") - F.col("zc")).alias("relief"))


def junction_angles(channel: DataFrame, places: DataFrame) -> DataFrame:
    """``node, donor1, donor2, angle`` in degrees between the directions of two donors, for each pair at a confluence."""
    p = places.select("node", "x", "y")
    d = channel.where("node <> receiver").select("node", "receiver").join(p, "node").join(p.select(F.col("node").alias("receiver"), F.col("x").alias("x0"), F.col("y").alias("y0")), "receiver")
    d = d.select("receiver", "node", (F.col("x") - F.col("x0")).alias("u"), (F.col("y") - F.col("y0")).alias("v"))
    e = d.select("receiver", F.col("node").alias("node2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    # A cell has at most eight donors, so pairs stay below 28 a node.
    pairs = d.join(e, "receiver").where("node < node2")
    dot = F.col("u") * F.col("u2") + F.col("v") * F.col("v2")
    cos = dot / F.sqrt((F.col("u") * F.col("u") + F.col("v") * F.col("v")) * (F.col("u2") * F.col("u2") + F.col("v2") * F.col("v2")))
    return pairs.select(F.col("receiver").alias("node"), F.col("node").alias("donor1"), F.col("node2").alias("donor2"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("angle"))


def links(channel: DataFrame, places: DataFrame) -> DataFrame:
    """``link, end, n, length, fall, ux, uy, r2, x0, y0, x1, y1``: each reach from a source or junction (link) down to the next junction or root (end).

    ``places`` has node, x, y, z.  ``ux, uy`` is the direction of the line of least perpendicular distance through the
    reach's nodes, both ends included, pointing downstream, and ``r2`` the squared correlation of its x and y (1 where either is constant).
    """
    d = flow.donors(channel)
    roots = channel.where("node = receiver").select("node")
    knots = store(d.where("n_donors <> 1").select("node").unionByName(roots).distinct(), "knots")
    # Going up from a node between knots ends at the knot where its reach begins.
    above = channel.where("node <> receiver").select(F.col("receiver").alias("node"), F.col("node").alias("receiver"))
    inner = channel.select("node").join(knots, "node", "left_anti").join(above, "node")
    up = inner.unionByName(knots.select("node", F.col("node").alias("receiver")))
    head = store(flow.to_root(up).select("node", F.col("root").alias("link")), "reach-heads")
    last = channel.where("node <> receiver").join(knots.select(F.col("node").alias("receiver")), "receiver", "left_semi").join(head, "node").select("link", F.col("receiver").alias("node"), F.lit(True).alias("is_end"))
    own = head.join(roots.withColumn("__root", F.lit(True)), "node", "left").where("__root IS NULL").select("link", "node", F.lit(False).alias("is_end"))
    rows = own.unionByName(last).join(places.select("node", "x", "y", "z"), "node").join(channel.select("node", "dx"), "node")
    at = lambda c, end: F.max(F.when(F.col("is_end") if end else F.col("node") == F.col("link"), F.col(c)))
    s = rows.groupBy("link").agg(
        at("node", True).alias("end"), F.count("*").alias("n"), F.sum(F.when(~F.col("is_end"), F.col("dx"))).alias("length"), (at("z", False) - at("z", True)).alias("fall"),
        *[at(c, e).alias(f"{c}{int(e)}") for c in "xy" for e in (False, True)], F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
    )
    turn = F.atan2(2 * F.round("xy", 9), F.round(F.col("xx") - F.col("yy"), 9)) / 2
    way = F.when(F.cos(turn) * (F.col("x1") - F.col("x0")) + F.sin(turn) * (F.col("y1") - F.col("y0")) >= 0, 1.0).otherwise(-1.0)
    r2 = F.when((F.round("xx", 9) > 0) & (F.round("yy", 9) > 0), F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy"))).otherwise(1.0)
    return s.select("link", "end", "n", "length", "fall", (F.cos(turn) * way).alias("ux"), (F.sin(turn) * way).alias("uy"), r2.alias("r2"), "x0", "y0", "x1", "y1")


def link_bearings(found: DataFrame) -> DataFrame:
    """``link, end, bearing, gradient``: degrees from north from a reach's begin to its end, and its fall over its length."""
    from catena.functions.geo import bearing

    return found.select("link", "end", bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bearing"), (F.col("fall") / F.col("length")).alias("gradient"))


def junction_angles_complete(found: DataFrame, orders: DataFrame, area: DataFrame, least_nodes: int = 9) -> DataFrame:
    """For each junction where two reaches meet and one leaves, all with enough nodes: angles, orders, areas and fits.

    ``angle_12, angle_1r, angle_2r`` are the degrees between the two donors (1: the smaller link) and the receiver, in the order in which they lie around the
    junction, so they sum to 360.  ``area`` has node and area.
    """
    whole = found.where(F.col("n") >= least_nodes)
    north = lambda u, v: F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))
    two = found.groupBy("end").agg(F.count("*").alias("__n"), F.min("link").alias("d1"), F.max("link").alias("d2")).where("__n = 2")
    # Donors point up from the junction, the receiver down from it.
    up = lambda k: whole.select(F.col("link").alias(f"d{k}"), north(-F.col("ux"), -F.col("uy")).alias(f"b{k}"), F.col("r2").alias(f"r2_{k}"))
    down = whole.select(F.col("link").alias("junction"), F.col("end").alias("receiver"), north(F.col("ux"), F.col("uy")).alias("br"), F.col("r2").alias("r2_r"))
    j = two.select(F.col("end").alias("junction"), "d1", "d2").join(up(1), "d1").join(up(2), "d2").join(down, "junction")
    a, b = (F.pmod(F.round(F.col(f"b{k}") - F.col("br"), 9), F.lit(360.0)) for k in (1, 2))
    j = j.withColumns({"t1": a, "t2": b})
    after = F.col("t2") > F.col("t1")
    angles = {"angle_12": F.abs(F.col("t2") - F.col("t1")), "angle_1r": F.when(after, F.col("t1")).otherwise(360 - F.col("t1")), "angle_2r": F.when(after, 360 - F.col("t2")).otherwise(F.col("t2"))}
    j = j.withColumns(angles)
    for name, at in (("1", "d1"), ("2", "d2"), ("r", "receiver"), ("j", "junction")):
        j = j.join(orders.select(F.col("node").alias(at), F.col("stream_order").alias(f"order_{name}")), at)
        if name != "j":
            j = j.join(area.select(F.col("node").alias(at), F.col("area").alias(f"area_{name}")), at)
    return j.select("junction", "d1", "d2", "receiver", *angles, "order_j", "order_1", "order_2", "order_r", "area_1", "area_2", "area_r", "r2_1", "r2_2", "r2_r")


def tokunaga(channel: DataFrame, orders: DataFrame) -> DataFrame:
    """``i, j, n``: streams of order i that end in a stream of order j."""
    o = channel.select("node", "receiver").join(orders, "node")
    r = orders.select(F.col("node").alias("receiver"), F.col("stream_order").alias("j"))
    ends = o.join(r, "receiver").where((F.col("node") != F.col("receiver")) & (F.col("stream_order") < F.col("j")))
    return ends.groupBy(F.col("stream_order").alias("i"), "j").agg(F.count("*").alias("n"))


def link_drops(orders: DataFrame, links: DataFrame, heights: DataFrame) -> DataFrame:
    """Height lost over each link (node, link) by order."""
    z = links.join(heights.select("node", "z"), "node").join(orders, "node")
    return z.groupBy("link").agg((F.max("z") - F.min("z")).alias("drop"), F.max("stream_order").alias("stream_order"))


def hypsometric_integral(nodes: DataFrame, heights: DataFrame) -> DataFrame:
    """``node, hi``: (mean - min) / (max - min) of all heights that drain to a node."""
    j = nodes.join(heights.select("node", F.col("z").alias("__z")), "node")
    a = flow.accumulate(j, {"total": F.col("__z"), "n": F.lit(1).cast("long")}, {"high": F.col("__z"), "minus_low": -F.col("__z")})
    low = -F.col("minus_low")
    return a.select("node", F.when(F.col("high") > low, (F.col("total") / F.col("n") - low) / (F.col("high") - low)).alias("hi"))


def perimeter(members: DataFrame) -> DataFrame:
    """Cells (row, col, basin) with one to seven neighbours outside their basin."""
    from catena.grid import STEPS, spread

    sent = spread(members, STEPS, "basin").groupBy("row", "col").agg(F.collect_list("sent").alias("near"))
    j = members.join(sent, ["row", "col"], "left")
    same = F.size(F.filter(F.coalesce("near", F.array().cast("array<long>")), lambda b: b == F.col("basin")))
    return j.withColumn("outside", F.lit(8) - same).where("outside > 0").select("row", "col", "basin", "outside")


def adjacent(members: DataFrame) -> DataFrame:
    """``basin, neighbour, n``: pairs of basins with touching cells and how many cell pairs touch."""
    from catena.grid import STEPS, spread

    sent = spread(members, STEPS, "basin")
    j = members.join(sent.select("row", "col", F.col("sent").alias("neighbour")), ["row", "col"]).where("basin <> neighbour")
    return j.groupBy("basin", "neighbour").agg(F.count("*").alias("n"))


def overlapping_channels(channel: DataFrame, sources: DataFrame, extra: int) -> DataFrame:
    """``source_key, node, pos, own``: every source's channel, downstream from its head (pos 0).

    A channel owns its nodes down to where a longer one owns them (``source_keys``), and goes on there for ``extra`` nodes
    more, so that neighbouring channels overlap.
    """
    keys = store(source_keys(channel, sources), "source-keys")
    steps = flow.to_root(channel).select("node", "depth")
    mine = keys.join(steps, "node").join(steps.select(F.col("node").alias("source_key"), F.col("depth").alias("__top")), "source_key")
    own = store(mine.select("source_key", "node", (F.col("__top") - F.col("depth")).alias("pos"), F.lit(True).alias("own")), "own-nodes")
    last = own.groupBy("source_key").agg(F.max(F.struct("pos", "node")).alias("l")).select("source_key", "l.pos", "l.node")
    ends = last.join(channel.where("node <> receiver").select("node", "receiver"), "node").select("source_key", "pos", F.col("receiver").alias("node"))
    if extra < 1:
        return own
    ways = flow.ancestors(channel, ends.select("node"), extra - 1)
    more = ends.join(ways, "node").select("source_key", F.col("ancestor").alias("node"), (F.col("pos") + 1 + F.col("steps")).alias("pos"), F.lit(False).alias("own"))
    return own.unionByName(more)


def channel_outlets(found: DataFrame) -> DataFrame:
    """``source_key, outlet``: the last node of each channel, overlap included."""
    return found.groupBy("source_key").agg(F.max_by("node", "pos").alias("outlet"))


def internal_nodes(members: DataFrame) -> DataFrame:
    """``row, col, basin`` of the cells whose eight neighbours belong to the same basin."""
    from catena.grid import STEPS, spread

    same = spread(members, STEPS, "basin").join(members, ["row", "col"]).where("sent = basin").groupBy("row", "col", "basin").agg(F.count("*").alias("n"))
    return same.where("n = 8").select("row", "col", "basin")


def overlap_window(profile: DataFrame, n: int) -> DataFrame:
    """The first ``n`` nodes of each channel past its confluence, by position downstream."""
    w = Window.partitionBy("source_key").orderBy("pos")
    return profile.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def spread_labels(members: DataFrame) -> DataFrame:
    """``row, col, near``: the basins of the eight neighbours of every cell."""
    from catena.grid import STEPS, spread

    return spread(members, STEPS, "basin").select("row", "col", F.col("sent").alias("near"))


def nesting(nodes: DataFrame, outlets: DataFrame) -> DataFrame:
    """``outlet, inside, depth``: every pair of outlets where one lies upstream of the other, and how many lie between, itself counted."""
    ways = flow.ancestors(nodes, outlets).where("steps > 0").join(outlets.select(F.col("node").alias("ancestor")), "ancestor")
    place = F.row_number().over(Window.partitionBy("node").orderBy("steps"))
    return ways.select(F.col("ancestor").alias("outlet"), F.col("node").alias("inside"), place.alias("depth"))


def prune_elevation(outlets: DataFrame, heights: DataFrame, low: float, high: float) -> DataFrame:
    """Outlets within a range of heights."""
    return outlets.join(heights.select("node", "z"), "node").where(F.col("z").between(low, high)).drop("z")


def largest_complete(nodes: DataFrame, counts: DataFrame, touched: DataFrame) -> DataFrame:
    """For each base-level basin the largest sub-basin that holds no touched node."""
    root = flow.to_root(nodes).select("node", "root")
    free = counts.join(touched.select("node"), "node", "left_anti").join(root, "node")
    best = free.groupBy("root").agg(F.max(F.struct("n_contrib", (-F.col("node")).alias("minus"))).alias("b"))
    return best.select("root", (-F.col("b.minus")).alias("node"), F.col("b.n_contrib").alias("n_contrib"))


def basin_summary(members: DataFrame, metrics: list[str], res: float = 1.0) -> DataFrame:
    """One wide row a basin: area, centre, and mean, median, deviation, extremes of each metric column."""
    parts = [(F.count("*") * res * res).alias("area"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col")]
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.percentile(F.col(m), F.lit(0.5)).alias(f"{m}_median"), F.stddev_pop(m).alias(f"{m}_sd"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return members.groupBy("basin").agg(*parts)


def drainage_density(members: DataFrame, channel: DataFrame, res: float = 1.0) -> DataFrame:
    """``basin, density, hillslope_length``: channel length over area, and half its inverse."""
    length = members.join(channel.select("node", "dx"), "node").groupBy("basin").agg(F.sum("dx").alias("length"))
    area = members.groupBy("basin").agg((F.count("*") * res * res).alias("area"))
    d = F.col("length") / F.col("area")
    return area.join(length, "basin").select("basin", d.alias("density"), F.when(d > 0, 1 / (2 * d)).alias("hillslope_length"))


def both_sides(edge: DataFrame, cells: DataFrame, members: DataFrame, radius: int) -> DataFrame:
    """``row, col, basin, inside, outside``: mean value near each perimeter cell within its basin and beyond."""
    from catena.grid import disc

    looks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disc(radius)])
    sent = edge.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("basin").alias("b0"), F.explode(looks).alias("m"))
    sent = sent.withColumns({"row": F.col("r0") + F.col("m.i"), "col": F.col("c0") + F.col("m.j")})
    j = sent.join(cells.select("row", "col", "value"), ["row", "col"]).join(members.select("row", "col", "basin"), ["row", "col"], "left")
    same = F.col("basin") == F.col("b0")
    out = j.groupBy("r0", "c0", "b0").agg(F.avg(F.when(same, F.col("value"))).alias("inside"), F.avg(F.when(~F.coalesce(same, F.lit(False)), F.col("value"))).alias("outside"))
    return out.toDF("row", "col", "basin", "inside", "outside")


def link_lengths(links: DataFrame) -> DataFrame:
    """Length of each link (node, dx, link) and its number of nodes."""
    return links.groupBy("link").agg(F.sum("dx").alias("length"), F.count("*").alias("n"))


def angle_statistics(angles: DataFrame, orders: DataFrame) -> DataFrame:
    """Mean, median and deviation of junction angles (node, angle) by stream order."""
    j = angles.join(orders, "node")
    return j.groupBy("stream_order").agg(F.avg("angle").alias("mean"), F.percentile(F.col("angle"), F.lit(0.5)).alias("median"), F.stddev_pop("angle").alias("sd"), F.count("*").alias("n"))

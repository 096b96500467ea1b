"""Meshes to points and simple solids to meshes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Vec, XYZ


def rasterize_mesh(vertices: DataFrame, faces: DataFrame, dl: float, v_id: str = "v_id", f_id: str = "f_id",
                   by: list[str] = ()) -> DataFrame:
    """Points on every face at spacing ``dl`` with the id of the nearest corner.

    A lattice along the two sides that meet at the face's widest angle, points
    on the three edges, and the corners. Faces smaller than ``dl`` give their
    centroid, degenerate ones nothing.
    """
    by = list(by)
    corner = vertices.select(*by, F.col(v_id).alias("_v"), F.struct(F.col(v_id).alias("v"), *XYZ).alias("_c"))
    tri = faces
    for i in (1, 2, 3):
        tri = tri.join(corner.withColumnsRenamed({"_v": f"v{i}", "_c": f"_c{i}"}), [*by, f"v{i}"])

    def at(k):
        return Vec(*(F.col(f"_c{k}")[a] for a in XYZ))

    # Side i lies opposite to corner i; corners are counted from 1.
    nxt = {1: 2, 2: 3, 3: 1}
    prv = {1: 3, 2: 1, 3: 2}
    sides = {i: at(prv[i]).minus(at(nxt[i])) for i in (1, 2, 3)}
    tri = tri.withColumns({f"_l{i}": sides[i].norm() for i in sides})
    longest, shortest = F.greatest("_l1", "_l2", "_l3"), F.least("_l1", "_l2", "_l3")
    tri = tri.where(shortest > 1e-9)
    widest = F.when(F.col("_l1") == longest, 1).when(F.col("_l2") == longest, 2).otherwise(3)
    tri = tri.withColumns({"_small": longest < dl, "_a": widest})

    def steps(length):
        start = (length % dl) / 2
        count = F.ceil((length - start) / dl - 1e-12).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: start + k * dl)

    corners = F.array("_c1", "_c2", "_c3")
    keep = tri.select(*by, f_id, "_small", "_a", "_c1", "_c2", "_c3", "_l1", "_l2", "_l3", corners.alias("_cs"))

    def pick(name, index):
        return F.get(F.array(*(F.col(f"{name}{i}") for i in (1, 2, 3))), index - 1)

    big = keep.where(~F.col("_small"))
    b = F.col("_a") % 3 + 1
    c = b % 3 + 1
    lat = big.select("*", pick("_c", F.col("_a")).alias("_pa"), pick("_c", b).alias("_pb"), pick("_c", c).alias("_pc"),
                     pick("_l", b).alias("_lb"), pick("_l", c).alias("_lc"))
    lat = lat.withColumn("_s", F.explode(steps(F.col("_lb")))).withColumn("_t", F.explode(steps(F.col("_lc"))))
    # Side b joins corners A and C, side c joins A and B.
    u, w = F.col("_s") / F.col("_lb"), F.col("_t") / F.col("_lc")
    lat = lat.where(u + w <= 1)
    point = {a: F.col("_pa")[a] + u * (F.col("_pc")[a] - F.col("_pa")[a]) + w * (F.col("_pb")[a] - F.col("_pa")[a]) for a in XYZ}
    parts = [lat.select(*by, f_id, "_cs", *(v.alias(a) for a, v in point.items()))]

    edge = big.withColumn("_i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    start_at, length = pick("_c", F.col("_i") % 3 + 1), pick("_l", F.col("_i"))
    end_at = pick("_c", (F.col("_i") + 1) % 3 + 1)
    edge = edge.select(*by, f_id, "_cs", start_at.alias("_p"), end_at.alias("_q"), length.alias("_len"))
    edge = edge.withColumn("_s", F.explode(steps(F.col("_len"))))
    share = F.col("_s") / F.col("_len")
    parts.append(edge.select(*by, f_id, "_cs", *((F.col("_p")[a] + share * (F.col("_q")[a] - F.col("_p")[a])).alias(a) for a in XYZ)))

    knots = big.withColumn("_p", F.explode("_cs"))
    parts.append(knots.select(*by, f_id, "_cs", *(F.col("_p")[a].alias(a) for a in XYZ)))
    middle = {a: (F.col("_c1")[a] + F.col("_c2")[a] + F.col("_c3")[a]) / 3 for a in XYZ}
    parts.append(keep.where("_small").select(*by, f_id, "_cs", *(v.alias(a) for a, v in middle.items())))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = F.array_min(F.transform("_cs", lambda k: F.struct(
        sum(((F.col(a) - k[a]) * (F.col(a) - k[a]) for a in "yz"), (F.col("x") - k["x"]) * (F.col("x") - k["x"])).alias("d"),
        k["v"].alias("v"))))
    return out.select(*by, f_id, *XYZ, ranked["v"].alias(v_id))


def cylinder_vertices(cylinders: DataFrame, by: list[str], precision: int = 24) -> DataFrame:
    """Vertices of a closed cylinder (cx, cy, cz, height, radius): two centres, then the top and bottom rims."""
    k = F.explode(F.sequence(F.lit(0), F.lit(2 * precision + 1)))
    v = cylinders.withColumn("v_id", k)
    rim = F.pmod(F.col("v_id") - 2, F.lit(precision))
    angle = rim * (2 * math.pi / precision)
    hub = F.col("v_id") < 2
    top = (F.col("v_id") == 0) | F.col("v_id").between(2, precision + 1)
    zero = F.lit(0.0)
    return v.select(*by, "v_id",
                    (F.col("cx") + F.when(hub, zero).otherwise(F.col("radius") * F.cos(angle))).alias("x"),
                    (F.col("cy") + F.when(hub, zero).otherwise(F.col("radius") * F.sin(angle))).alias("y"),
                    (F.col("cz") + F.when(top, F.col("height") / 2).otherwise(-F.col("height") / 2)).alias("z"))


def cylinder_faces(cylinders: DataFrame, by: list[str], precision: int = 24) -> DataFrame:
    """Triangles over :func:`cylinder_vertices`: lids around the centres, two per side panel."""
    n = precision
    f = cylinders.select(*by).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    f = f.withColumn("_part", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    i, j = F.col("_i"), (F.col("_i") + 1) % n
    top, top2, low, low2 = i + 2, j + 2, i + (n + 2), j + (n + 2)
    faces = [(F.lit(0), top, top2), (F.lit(1), low, low2), (top, low, low2), (low2, top, top2)]
    choose = lambda pos: F.get(F.array(*(face[pos].cast("int") for face in faces)), F.col("_part"))
    return f.select(*by, (F.col("_part") * n + i).alias("f_id"), *(choose(p).alias(f"v{p + 1}") for p in range(3)))

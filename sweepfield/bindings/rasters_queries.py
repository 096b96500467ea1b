"""Rasters over time."""


from pyspark.sql import functions as F

from ..operators import raster as ra
from .registry import LATTICE, lattice, longs, query, rounded, table

RES = ra.HALF_DEGREE
ANGLE = f"least(CAST(floor((atan2(y-4.3,x-25.4)+pi())/{RES!r}) AS INTEGER), 720)"


def centred(spark, sf):
    return lattice(spark, sf).withColumns({"cx": F.lit(25.4), "cy": F.lit(4.3)})


@query("raster_visibility_ranges", f"""WITH {LATTICE}, h AS (SELECT session, {ANGLE} AS bin, min(sqrt((x-25.4)*(x-25.4)+(y-4.3)*(y-4.3))) AS r FROM pts WHERE z BETWEEN 2 AND 5 GROUP BY ALL),
d AS (SELECT session, bin FROM (SELECT DISTINCT session FROM h), (SELECT unnest(range(721)) AS bin)),
j AS (SELECT d.session, d.bin, h.r FROM d LEFT JOIN h ON h.session=d.session AND h.bin=d.bin),
e AS (SELECT session, bin+o AS bin, r FROM h, (SELECT unnest([-721,0,721]) AS o)),
n AS (SELECT j.*, p.bin AS pb, p.r AS pr FROM j ASOF JOIN e p ON p.session=j.session AND j.bin >= p.bin),
m AS (SELECT n.*, q.bin AS nb, q.r AS nr FROM n ASOF JOIN e q ON q.session=n.session AND n.bin <= q.bin)
SELECT session, CAST(bin AS BIGINT) AS bin, round(CASE WHEN r IS NOT NULL THEN r ELSE (1-(bin-pb)/(nb-pb))*pr+(bin-pb)/(nb-pb)*nr END,6) AS range, r IS NOT NULL AS seen FROM m""")
def raster_visibility_ranges(spark, sf):
    return longs(rounded(ra.visibility_ranges(centred(spark, sf), ["session"], 2, 5), "range"), "bin")


@query("raster_grid_visibility", f"""WITH {LATTICE}, b AS (SELECT session, CAST(min(floor(x/2)) AS BIGINT) x0, CAST(max(floor(x/2)) AS BIGINT) x1, CAST(min(floor(y/2)) AS BIGINT) y0, CAST(max(floor(y/2)) AS BIGINT) y1 FROM pts GROUP BY session),
c AS (SELECT session, unnest(generate_series(x0,x1)) AS px, y0, y1 FROM b), g AS (SELECT session, px, unnest(generate_series(y0,y1)) AS py FROM c),
q AS (SELECT *, CAST((px+0.5)*2 AS DOUBLE) AS x, CAST((py+0.5)*2 AS DOUBLE) AS y FROM g), p AS (SELECT session, px, py, {ANGLE} AS bin, (x-25.4)*(x-25.4)+(y-4.3)*(y-4.3) AS d2 FROM q),
r AS (SELECT session, {ANGLE} AS bin, (x-25.4)*(x-25.4)+(y-4.3)*(y-4.3) AS d2 FROM pts WHERE z BETWEEN 2 AND 5)
SELECT p.session, px, py, round(coalesce(avg(CASE WHEN r.d2 > p.d2 THEN 1.0 WHEN r.d2 IS NOT NULL THEN 0.0 END),0),6) AS score, count(r.d2) AS rays FROM p LEFT JOIN r ON r.session=p.session AND r.bin=p.bin GROUP BY ALL""")
def raster_grid_visibility(spark, sf):
    return rounded(ra.grid_visibility(centred(spark, sf), ["session"], 2.0, 2, 5), "score")


# 2D+time cloud: positions from price and quantity, time from the tax, class from the line number.
CLOUD = """cl AS (SELECT l_suppkey%8 AS grp, (l_quantity-25.5)/10 AS x, (l_discount-0.05)*40+0.013 AS y, (l_tax*100-2)*0.11 AS t, 2+l_linenumber%3 AS classif FROM lineitem)"""


def cloud(spark, sf, where=None):
    t = table(spark, sf, "lineitem")
    return (t if where is None else t.where(where)).select((F.col("l_suppkey") % 8).alias("grp"), ((F.col("l_quantity") - 25.5) / 10).alias("x"),
                                               ((F.col("l_discount") - 0.05) * 40 + 0.013).alias("y"), ((F.col("l_tax") * 100 - 2) * 0.11).alias("t"),
                                               (2 + F.col("l_linenumber") % 3).alias("classif"))


OCCUPANCY = f"""WITH {CLOUD}, ly AS (SELECT k, -0.2+k*0.1 AS tau FROM (SELECT unnest(range(9)) AS k)),
nr AS (SELECT grp, k, x, y, classif, abs(t-tau) AS off FROM cl, ly WHERE abs(t-tau) < 0.05*5/2),
ex AS (SELECT *, CASE WHEN off<0.025 THEN 1 WHEN off<0.05 THEN 2 WHEN off<0.075 THEN 3 WHEN off<0.1 THEN 4 ELSE 5 END AS e FROM nr),
mn AS (SELECT grp, k, min(e) AS e FROM ex GROUP BY ALL), ch AS (SELECT ex.* FROM ex JOIN mn USING (grp,k) WHERE ex.e=mn.e),
nd AS (SELECT i AS px, j AS py, -2+i*0.25 AS gx, -2+j*0.25 AS gy FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j)),
ct AS (SELECT grp, k, px, py, sum(CASE WHEN classif=2 THEN 1.0 ELSE 0 END) AS s, sum(CASE WHEN classif=3 THEN 1.0 ELSE 0 END) AS l, sum(CASE WHEN classif=4 THEN 1.0 ELSE 0 END) AS m
 FROM ch JOIN nd ON (x-gx)*(x-gx)+(y-gy)*(y-gy) < 0.25*0.25/2 GROUP BY ALL),
fx AS (SELECT grp, px, py, sum(s)/9 AS s, sum(l)/9 AS l FROM ct GROUP BY ALL), tp AS (SELECT grp, max(s) AS ts, max(l) AS tl FROM fx GROUP BY grp),
al AS (SELECT fx.grp, ly.k, fx.px, fx.py, CASE WHEN ts>1 THEN fx.s/(ts+1e-9) ELSE fx.s END AS s, CASE WHEN tl>1 THEN fx.l/(tl+1e-9) ELSE fx.l END AS l, least(coalesce(ct.m,0),10)/10 AS m
 FROM fx JOIN tp USING (grp) CROSS JOIN ly LEFT JOIN ct ON ct.grp=fx.grp AND ct.k=ly.k AND ct.px=fx.px AND ct.py=fx.py),
oc AS (SELECT grp, k AS t_idx, px, py, CASE WHEN s>0.01 THEN 0.5*(s+1) ELSE s END AS still, CASE WHEN l>0.01 THEN 0.5*(l+1) ELSE l END AS long_t, CASE WHEN m>0.01 THEN 0.5*(m+1) ELSE m END AS short_t FROM al)"""


def occupancy(spark, sf):
    return ra.future_occupancy(cloud(spark, sf), ["grp"], 3, 0.6, 6, 2.0, 0.25)


@query("raster_future_occupancy", OCCUPANCY + " SELECT grp, t_idx, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, round(still,6) AS still, round(long_t,6) AS long_t, round(short_t,6) AS short_t FROM oc")
def raster_future_occupancy(spark, sf):
    return longs(rounded(occupancy(spark, sf), "still", "long_t", "short_t"), "t_idx", "px", "py")


@query("raster_merged_target", OCCUPANCY + " SELECT grp, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, round(max(CASE WHEN t_idx=2 THEN still END),6) AS still, round(max(CASE WHEN t_idx=2 THEN long_t END),6) AS long_t, round(max(short_t),6) AS short_t FROM oc GROUP BY ALL")
def raster_merged_target(spark, sf):
    return longs(rounded(ra.merged_target(occupancy(spark, sf), ["grp"], 2), "still", "long_t", "short_t"), "px", "py")


SIG = "1/(1+exp(-(l_discount*40-3)))"


@query("raster_cell_errors", f"""WITH c AS (SELECT month(l_shipdate) AS t, {SIG} AS pa, l_tax AS pb, CASE WHEN l_returnflag='R' THEN 1.0 ELSE 0.0 END AS ga, l_quantity/100 AS gb FROM lineitem),
m AS (SELECT *, CASE WHEN pa+pb>0.1 THEN 1.0 ELSE 0 END AS fp, CASE WHEN ga+gb>0.01 THEN 1.0 ELSE 0 END AS fn FROM c)
SELECT t, round(100*avg(abs(pa-ga)),6) AS a_all, round(100*sum(abs(pa-ga)*fp)/(sum(fp)+1e-9),6) AS a_fp, round(100*sum(abs(pa-ga)*fn)/(sum(fn)+1e-9),6) AS a_fn,
 round(100*avg(abs(pb-gb)),6) AS b_all, round(100*sum(abs(pb-gb)*fp)/(sum(fp)+1e-9),6) AS b_fp, round(100*sum(abs(pb-gb)*fn)/(sum(fn)+1e-9),6) AS b_fn FROM m GROUP BY t""")
def raster_cell_errors(spark, sf):
    from ..functions.geometry import sigmoid

    c = table(spark, sf, "lineitem").select(F.month("l_shipdate").cast("long").alias("t"), sigmoid(F.col("l_discount") * 40 - 3).alias("p_a"), F.col("l_tax").alias("p_b"),
                                            (F.col("l_returnflag") == "R").cast("double").alias("g_a"), (F.col("l_quantity") / 100).alias("g_b"))
    out = ra.cell_errors(c, ["t"], ["a", "b"], logits=False)
    return rounded(out, *(f"{a}_{k}" for a in "ab" for k in ("all", "fp", "fn")))


@query("raster_cell_errors_bce", """WITH c AS (SELECT month(l_shipdate) AS t, l_discount*40-3 AS z, CASE WHEN l_returnflag='R' THEN 1.0 ELSE 0.0 END AS g FROM lineitem)
SELECT t, round(100*avg(greatest(z,0)-z*g+ln(1+exp(-abs(z)))),6) AS a_all FROM c GROUP BY t""")
def raster_cell_errors_bce(spark, sf):
    c = table(spark, sf, "lineitem").select(F.month("l_shipdate").cast("long").alias("t"), (F.col("l_discount") * 40 - 3).alias("p_a"),
                                            (F.col("l_returnflag") == "R").cast("double").alias("g_a"))
    return rounded(ra.cell_errors(c, ["t"], ["a"], error="bce").select("t", "a_all"), "a_all")


# Prediction and truth: the clouds of even and of odd orders. The SQL makes every node of the grid.
HALVES = ", ".join(f"{name} AS ({OCCUPANCY.replace('FROM lineitem)', f'FROM lineitem WHERE l_orderkey % 2 = {odd})')} SELECT * FROM oc)" for name, odd in (("pr", 0), ("tr", 1)))
DENSE = f"""WITH {HALVES}, al AS (SELECT g.grp, t.t_idx, i AS px, j AS py FROM (SELECT DISTINCT grp FROM pr UNION SELECT grp FROM tr) g, (SELECT unnest(range(9)) AS t_idx) t, (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j)),
dn AS (SELECT al.grp, al.t_idx, coalesce(pr.still,0) AS ps, coalesce(pr.short_t,0) AS pm, coalesce(tr.still,0) AS gs, coalesce(tr.short_t,0) AS gm FROM al
 LEFT JOIN pr ON pr.grp=al.grp AND pr.t_idx=al.t_idx AND pr.px=al.px AND pr.py=al.py LEFT JOIN tr ON tr.grp=al.grp AND tr.t_idx=al.t_idx AND tr.px=al.px AND tr.py=al.py)"""
HALF_ERRORS = """ SELECT grp, t_idx, round(100*avg(abs({s}-gs))+1e-9,6) AS still_all, round(100*sum(abs({s}-gs)*({s}+{m}>0.1)::INT)/(sum(({s}+{m}>0.1)::INT)+1e-9)+1e-9,6) AS still_fp, round(100*sum(abs({s}-gs)*(gs+gm>0.01)::INT)/(sum((gs+gm>0.01)::INT)+1e-9)+1e-9,6) AS still_fn,
 round(100*avg(abs({m}-gm))+1e-9,6) AS short_t_all, round(100*sum(abs({m}-gm)*({s}+{m}>0.1)::INT)/(sum(({s}+{m}>0.1)::INT)+1e-9)+1e-9,6) AS short_t_fp, round(100*sum(abs({m}-gm)*(gs+gm>0.01)::INT)/(sum((gs+gm>0.01)::INT)+1e-9)+1e-9,6) AS short_t_fn FROM dn GROUP BY ALL"""


def _off_ties(df, *names):
    """Rounded after a tiny step: means of eighths fall on ties, where the order of additions would show."""
    return rounded(df.withColumns({n: F.col(n) + 1e-9 for n in names}), *names)


def halves(spark, sf):
    return [ra.future_occupancy(cloud(spark, sf, F.col("l_orderkey") % 2 == odd), ["grp"], 3, 0.6, 6, 2.0, 0.25) for odd in (0, 1)]


def _half_errors(spark, sf, logits):
    cells = ra.aligned_grids(*halves(spark, sf), ["grp", "t_idx", "px", "py"], ["still", "short_t"])
    out = ra.cell_errors(cells, ["grp", "t_idx"], ["still", "short_t"], logits=logits, nodes=ra.grid_nodes(2.0, 0.25))
    return longs(_off_ties(out, *(f"{a}_{k}" for a in ("still", "short_t") for k in ("all", "fp", "fn"))), "t_idx")


@query("raster_sparse_errors", DENSE + HALF_ERRORS.format(s="ps", m="pm"))
def raster_sparse_errors(spark, sf):
    """Means over every node of the grid, from the touched ones and their number."""
    return _half_errors(spark, sf, False)


@query("raster_sparse_errors_logits", DENSE + HALF_ERRORS.format(s="(1/(1+exp(-ps)))", m="(1/(1+exp(-pm)))"))
def raster_sparse_errors_logits(spark, sf):
    """An untouched node is a prediction of one half here, so it counts in every mean."""
    return _half_errors(spark, sf, True)


@query("raster_sparse_means", DENSE + " SELECT grp, t_idx, round(avg(ps)+1e-9,6) AS still, round(avg(pm)+1e-9,6) AS short_t FROM dn GROUP BY ALL")
def raster_sparse_means(spark, sf):
    out = ra.grid_means(halves(spark, sf)[0], ["grp", "t_idx"], ["still", "short_t"], ra.grid_nodes(2.0, 0.25)).drop("touched")
    return longs(_off_ties(out, "still", "short_t"), "t_idx")


DISC = "ds AS (SELECT a.i AS i, b.i AS j, pow(1-sqrt(a.i*a.i+b.i*b.i)*0.25/0.75,3) AS w FROM (SELECT generate_series AS i FROM generate_series(-3,3)) a, (SELECT generate_series AS i FROM generate_series(-3,3)) b WHERE 1-sqrt(a.i*a.i+b.i*b.i)*0.25/0.75 > 0)"
HYST = "CASE WHEN {c}<=0.05 THEN 0 WHEN {c}<0.08 THEN {c}*pow(1-pow(({c}-0.08)/0.03,2),2) ELSE {c} END"


@query("raster_risk_diffusion", OCCUPANCY + f""", {DISC}, st AS (SELECT grp, px, py, greatest({HYST.format(c='still')},{HYST.format(c='long_t')}) AS v FROM oc WHERE t_idx=0),
o1 AS (SELECT grp, px+i AS px, py+j AS py, sum(v*w) AS v FROM st, ds WHERE v>0 GROUP BY grp, px+i, py+j), rt AS (SELECT st.grp, st.px, st.py, st.v/(o1.v+1e-6) AS v FROM st JOIN o1 USING (grp,px,py) WHERE st.v>0),
s2 AS (SELECT grp, px+i AS px, py+j AS py, pow(sum(v*w),1/3.0::DOUBLE) AS s FROM rt, ds WHERE px+i BETWEEN 0 AND 15 AND py+j BETWEEN 0 AND 15 GROUP BY grp, px+i, py+j),
mo AS (SELECT grp, t_idx, px, py, {HYST.format(c='short_t')} AS v FROM oc), m2 AS (SELECT grp, t_idx, px+i AS px, py+j AS py, pow(sum(v*w),1/3.0::DOUBLE) AS m FROM mo, ds WHERE v>0 AND px+i BETWEEN 0 AND 15 AND py+j BETWEEN 0 AND 15 GROUP BY grp, t_idx, px+i, py+j),
ts AS (SELECT grp, max(s) AS s FROM s2 GROUP BY grp), tm AS (SELECT grp, max(m) AS m FROM m2 GROUP BY grp), lt AS (SELECT DISTINCT grp, t_idx FROM oc),
bs AS (SELECT s2.grp, t_idx, px, py, s FROM s2 JOIN lt USING (grp))
SELECT coalesce(bs.grp,m2.grp) AS grp, coalesce(bs.t_idx,m2.t_idx) AS t_idx, CAST(coalesce(bs.px,m2.px) AS BIGINT) AS px, CAST(coalesce(bs.py,m2.py) AS BIGINT) AS py,
 round(greatest(coalesce(bs.s/ts.s,0),coalesce(m2.m/tm.m,0)),6) AS risk FROM bs FULL JOIN m2 ON bs.grp=m2.grp AND bs.t_idx=m2.t_idx AND bs.px=m2.px AND bs.py=m2.py
 LEFT JOIN ts ON ts.grp=coalesce(bs.grp,m2.grp) LEFT JOIN tm ON tm.grp=coalesce(bs.grp,m2.grp)""")
def raster_risk_diffusion(spark, sf):
    out = ra.diffuse_risk(occupancy(spark, sf), ["grp"], 0.25, 0.75, 3.0, 16)
    return longs(rounded(out, "risk"), "t_idx", "px", "py")


@query("raster_local_maxima", f"""WITH {LATTICE}, g AS (SELECT session, CAST(x AS BIGINT) AS px, CAST(y AS BIGINT) AS py, CAST(count(*) AS DOUBLE) AS v FROM pts GROUP BY ALL),
n AS (SELECT a.session, a.px, a.py, any_value(a.v) AS v, max(b.v) AS hi, min(b.v) AS lo FROM g a JOIN g b ON a.session=b.session AND abs(a.px-b.px)<=2 AND abs(a.py-b.py)<=2 GROUP BY ALL)
SELECT session, px, py, v FROM n WHERE v=hi AND hi-lo > 5""")
def raster_local_maxima(spark, sf):
    g = lattice(spark, sf).groupBy("session", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return ra.local_maxima(g, ["session"], "v", 5, 5)

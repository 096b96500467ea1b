"""Scores of predictions."""

from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..plans import reports
from .registry import longs, query, rounded, table

FLAGS = {"A": 0, "N": 1, "R": 2}
E6 = "1e-6"


def graded(spark, sf):
    """Return flag as truth, line status as prediction, discount as probability."""
    t = table(spark, sf, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.select((F.col("l_suppkey") % 8).alias("grp"), (F.month("l_shipdate") - 1).alias("t_idx"), code.alias("truth"),
                    F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("pred"),
                    (F.col("l_returnflag") == "R").alias("hit"), (F.col("l_discount") * 10).alias("prob"),
                    F.year("l_shipdate").alias("epoch"), F.col("l_linenumber").alias("obj"), "l_partkey", "l_quantity", "l_tax", "l_discount")


GRADED = """gr AS (SELECT l_suppkey%8 AS grp, CAST(month(l_shipdate)-1 AS BIGINT) AS t_idx, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS truth,
 CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS pred, l_returnflag='R' AS hit, l_discount*10 AS prob, year(l_shipdate) AS epoch, l_linenumber AS obj, l_partkey, l_quantity, l_tax, l_discount FROM lineitem)"""
LABELS = "lb AS (SELECT unnest([0,1,2]) AS label)"
CONF = f"""WITH {GRADED}, {LABELS}, c0 AS (SELECT grp, truth, pred, count(*) AS n FROM gr GROUP BY ALL), g AS (SELECT DISTINCT grp FROM gr),
cf AS (SELECT g.grp, a.label AS truth, b.label AS pred, coalesce(c0.n,0) AS n FROM g, lb a, lb b LEFT JOIN c0 ON c0.grp=g.grp AND c0.truth=a.label AND c0.pred=b.label),
mg AS (SELECT grp, label, sum(n) FILTER (truth=label AND pred=label) AS tp, sum(n) FILTER (truth=label) AS row_sum, sum(n) FILTER (pred=label) AS col_sum FROM cf, lb GROUP BY ALL)"""


@query("metric_confusion", CONF + " SELECT grp, CAST(truth AS BIGINT) AS truth, CAST(pred AS BIGINT) AS pred, CAST(n AS BIGINT) AS n FROM cf")
def metric_confusion(spark, sf):
    return longs(sc.confusion(graded(spark, sf), [0, 1, 2], by=["grp"]), "truth", "pred", "n")


@query("metric_class_scores", CONF + f""" SELECT grp, CAST(label AS BIGINT) AS label, round(tp/(col_sum+{E6}),6) AS pre, round(tp/(row_sum+{E6}),6) AS rec, round(2*tp/(row_sum+col_sum+{E6}),6) AS f1,
 round((2*tp/(row_sum+col_sum+{E6}))/(2-(2*tp/(row_sum+col_sum+{E6}))),6) AS iou, round(sum(tp) OVER (PARTITION BY grp)/(sum(row_sum) OVER (PARTITION BY grp)+{E6}),6) AS acc FROM mg""")
def metric_class_scores(spark, sf):
    out = sc.class_metrics(sc.confusion(graded(spark, sf), [0, 1, 2], by=["grp"]), ["grp"])
    return longs(rounded(out, "pre", "rec", "f1", "iou", "acc"), "label")


@query("metric_iou", CONF + f""", i AS (SELECT *, tp/(row_sum+col_sum-tp+{E6}) AS v FROM mg)
 SELECT grp, CAST(label AS BIGINT) AS label, round(CASE WHEN row_sum<0.001 THEN (sum(v) FILTER (row_sum>=0.001) OVER (PARTITION BY grp))/(count(*) FILTER (row_sum>=0.001) OVER (PARTITION BY grp)+{E6}) ELSE v END,6) AS iou FROM i""")
def metric_iou(spark, sf):
    return longs(rounded(sc.class_iou(sc.confusion(graded(spark, sf), [0, 1, 2], by=["grp"]), ["grp"]), "iou"), "label")


@query("metric_ignored_labels", CONF + " SELECT grp, CAST(sum(n) AS BIGINT) AS n FROM cf WHERE truth<>0 AND pred<>0 GROUP BY grp")
def metric_ignored_labels(spark, sf):
    from ..operators.filters import drop_ignored

    conf = sc.confusion(graded(spark, sf), [0, 1, 2], by=["grp"])
    return drop_ignored(conf, [0]).groupBy("grp").agg(F.sum("n").alias("n"))


@query("metric_doc_labels", """
WITH c AS (SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT unnest([0,1]) AS v)
SELECT CAST(a.v AS BIGINT) AS truth, CAST(b.v AS BIGINT) AS pred, coalesce(n,0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.truth=a.v AND c.pred=b.v""")
def metric_doc_labels(spark, sf):
    return longs(sc.confusion(table(spark, sf, "labels"), [0, 1], "quality", "toxic"), "truth", "pred", "n")


EPOCHS = f"""WITH {GRADED}, c AS (SELECT epoch, truth, pred, count(*) AS n FROM gr GROUP BY ALL), e AS (SELECT DISTINCT epoch FROM gr), l AS (SELECT unnest([0,1,2]) AS v),
cf AS (SELECT e.epoch, a.v AS truth, b.v AS pred, coalesce(n,0) AS n FROM e, l a, l b LEFT JOIN c ON c.epoch=e.epoch AND c.truth=a.v AND c.pred=b.v)"""


@query("metric_smoothed_confusion", EPOCHS + """ SELECT epoch, CAST(truth AS BIGINT) AS truth, CAST(pred AS BIGINT) AS pred,
 CAST(sum(n) OVER (PARTITION BY truth,pred ORDER BY epoch ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM cf""")
def metric_smoothed_confusion(spark, sf):
    conf = sc.confusion(graded(spark, sf), [0, 1, 2], by=["epoch"])
    return longs(sc.smoothed_confusion(conf, "epoch", 1), "epoch", "truth", "pred")


@query("metric_smoothed_iou", EPOCHS + f""", m AS (SELECT epoch, v AS label, sum(n) FILTER (truth=v AND pred=v) AS tp, sum(n) FILTER (truth=v) AS r, sum(n) FILTER (pred=v) AS k FROM cf, l GROUP BY ALL),
i AS (SELECT epoch, label, tp/(r+k-tp+{E6}) AS iou FROM m), s AS (SELECT epoch, label, avg(iou) OVER (PARTITION BY label ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS iou FROM i)
SELECT epoch, CAST(label AS BIGINT) AS label, round(iou,6) AS iou, round(avg(iou) OVER (PARTITION BY epoch),6) AS miou FROM s""")
def metric_smoothed_iou(spark, sf):
    ious = sc.class_iou(sc.confusion(graded(spark, sf), [0, 1, 2], by=["epoch"]), ["epoch"])
    return longs(rounded(sc.smoothed_iou(ious, "epoch", 2), "iou", "miou"), "epoch", "label")


@query("metric_balanced", CONF + f""", p AS (SELECT truth, count(*)/(SELECT count(*) FROM gr) AS share FROM gr GROUP BY truth), r AS (SELECT grp, truth, sum(n) AS rs FROM cf GROUP BY ALL)
SELECT cf.grp, CAST(cf.truth AS BIGINT) AS truth, CAST(pred AS BIGINT) AS pred, round(n*share/(rs+{E6}),6) AS n FROM cf JOIN r USING (grp,truth) JOIN p ON p.truth=cf.truth""")
def metric_balanced(spark, sf):
    g = graded(spark, sf)
    total = g.agg(F.count(F.lit(1)).alias("_t")).withColumn("_k", F.lit(0))
    share = (g.groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
             .join(F.broadcast(total), "_k").select("label", (F.col("n") / F.col("_t")).alias("share")))
    out = sc.balanced_confusion(sc.confusion(g, [0, 1, 2], by=["grp"]), share, ["grp"])
    return longs(rounded(out, "n"), "truth", "pred")


@query("metric_accuracy", f"WITH {GRADED} SELECT grp, round(count(*) FILTER (truth=pred)/(count(*)+{E6}),6) AS acc, count(*) AS n FROM gr GROUP BY grp")
def metric_accuracy(spark, sf):
    return rounded(sc.accuracy(sc.confusion(graded(spark, sf), [0, 1, 2], by=["grp"]), ["grp"]), "acc")


SWEEP = f"""WITH {GRADED}, k AS (SELECT unnest(range(50)) AS k),
s AS (SELECT grp, t_idx, k, 1-k/50.0::DOUBLE AS threshold, count(*) FILTER (hit AND prob > 1-k/50.0::DOUBLE) AS tp, count(*) FILTER (NOT hit AND prob > 1-k/50.0::DOUBLE) AS fp,
 count(*) FILTER (hit AND NOT prob > 1-k/50.0::DOUBLE) AS fn FROM gr, k GROUP BY ALL)"""


@query("metric_threshold_sweep", SWEEP + " SELECT grp, t_idx, CAST(k AS BIGINT) AS k, round(threshold,6) AS threshold, tp, fp, fn FROM s")
def metric_threshold_sweep(spark, sf):
    return longs(rounded(sc.threshold_counts(graded(spark, sf), ["grp", "t_idx"], "hit", "prob"), "threshold"), "k", "t_idx")


CURVE = SWEEP + f""", c AS (SELECT grp, t_idx, k, threshold, tp/(fp+tp+{E6}) AS pre, tp/(fn+tp+{E6}) AS rec, 2*tp/(2*tp+fp+fn+{E6}) AS f1 FROM s)"""


@query("metric_pr_curve", CURVE + " SELECT grp, t_idx, CAST(k AS BIGINT) AS k, round(pre,6) AS pre, round(rec,6) AS rec, round(f1,6) AS f1 FROM c")
def metric_pr_curve(spark, sf):
    by = ["grp", "t_idx"]
    out = sc.pr_curve(sc.threshold_counts(graded(spark, sf), by, "hit", "prob"), by)
    return longs(rounded(out, "pre", "rec", "f1").drop("threshold"), "k", "t_idx")


AP = CURVE + """, a AS (SELECT *, CASE WHEN k>=40 AND rec<0.01 THEN 1.0 ELSE rec END AS r FROM c),
d AS (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY grp,t_idx ORDER BY k),0) AS dr FROM a), ap AS (SELECT grp, t_idx, sum(dr*pre) AS ap FROM d GROUP BY ALL)"""


@query("metric_average_precision", AP + " SELECT grp, t_idx, round(ap,6) AS ap FROM ap")
def metric_average_precision(spark, sf):
    by = ["grp", "t_idx"]
    curve = sc.pr_curve(sc.threshold_counts(graded(spark, sf), by, "hit", "prob"), by)
    return longs(rounded(sc.average_precision(curve, by), "ap"), "t_idx")


@query("metric_best_thresholds", CURVE + """, m AS (SELECT grp, k, threshold, avg(f1) AS a, avg(f1) FILTER (t_idx > 1) AS l FROM c GROUP BY ALL)
SELECT grp, round(arg_max(threshold, struct_pack(v:=round(a,9), k:=-k)),6) AS best_mean, round(arg_max(threshold, struct_pack(v:=round(l,9), k:=-k)),6) AS best_last, round(max(a),6) AS f1_mean, round(max(l),6) AS f1_last FROM m GROUP BY grp""")
def metric_best_thresholds(spark, sf):
    by = ["grp", "t_idx"]
    curve = sc.pr_curve(sc.threshold_counts(graded(spark, sf), by, "hit", "prob"), by)
    return rounded(sc.best_thresholds(curve, "t_idx", ["grp"]), "best_mean", "best_last", "f1_mean", "f1_last")


@query("metric_comparison", AP + """, e AS (SELECT grp, 1e4*avg((prob-CAST(hit AS DOUBLE))*(prob-CAST(hit AS DOUBLE))) AS mse FROM gr GROUP BY grp)
SELECT grp, round(max(100*ap) FILTER (t_idx=3),5) AS ap_3, round(max(100*ap) FILTER (t_idx=10),5) AS ap_10, round(100*avg(ap),5) AS map, round(max(mse),4) AS mse FROM ap JOIN e USING (grp) GROUP BY grp""")
def metric_comparison(spark, sf):
    out = reports.comparison(graded(spark, sf), ["grp"], "t_idx", "hit", "prob", at=(3, 10))
    return out.select("grp", *(F.round(c, 5).alias(c) for c in ("ap_3", "ap_10", "map")), F.round("mse", 4).alias("mse"))


@query("metric_part_iou", f"""WITH {GRADED}, c AS (SELECT grp, obj, truth, pred, count(*) AS n FROM gr GROUP BY ALL), g AS (SELECT DISTINCT grp, obj FROM gr), l AS (SELECT unnest([0,1,2]) AS v),
m AS (SELECT g.grp, g.obj, v, coalesce(sum(n) FILTER (truth=v AND pred=v),0) AS tp, coalesce(sum(n) FILTER (truth=v),0) AS r, coalesce(sum(n) FILTER (pred=v),0) AS k FROM g CROSS JOIN l JOIN c USING (grp,obj) GROUP BY ALL),
i AS (SELECT *, tp/(r+k-tp+{E6}) AS iou FROM m), f AS (SELECT grp, obj, avg(CASE WHEN r=0 THEN (SELECT sum(iou)/(count(*)+{E6}) FROM i j WHERE j.grp=i.grp AND j.obj=i.obj AND j.r>0) ELSE iou END) AS miou FROM i GROUP BY ALL)
SELECT grp, round(avg(miou),6) AS miou, count(*) AS n FROM f GROUP BY grp""")
def metric_part_iou(spark, sf):
    return rounded(sc.part_iou(graded(spark, sf), "obj", "grp", [0, 1, 2])["categories"], "miou")


@query("metric_cross_confusion", f"""WITH {GRADED} SELECT obj, CAST(sum(CASE WHEN pred=0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0, CAST(sum(CASE WHEN pred=1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1 FROM gr GROUP BY obj""")
def metric_cross_confusion(spark, sf):
    return sc.cross_confusion(graded(spark, sf), "obj", "pred", [0, 1])


VOTES = f"""WITH v AS (SELECT user_id AS pid, event_id, value/500 AS p1, 1-value/500 AS p2, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)"""


def votes(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("pid"), "event_id", (F.col("value") / 500).alias("p1"), (1 - F.col("value") / 500).alias("p2"))


@query("votes_smoothed", VOTES + " SELECT pid, round(sum(p1*0.05*pow(0.95,rn-1)),6) AS p1, round(sum(p2*0.05*pow(0.95,rn-1)),6) AS p2, count(*) AS votes FROM v GROUP BY pid")
def votes_smoothed(spark, sf):
    return rounded(sc.smoothed_votes(votes(spark, sf), ["pid"], "event_id", ["p1", "p2"], 0.95), "p1", "p2")


@query("votes_mean", VOTES + " SELECT pid, round(avg(p1),6) AS p1, round(avg(p2),6) AS p2, count(*) AS votes FROM v GROUP BY pid")
def votes_mean(spark, sf):
    return rounded(sc.mean_votes(votes(spark, sf), ["pid"], ["p1", "p2"]), "p1", "p2")


# Unquantised and without sign alignment the ordered fold must equal the closed form.
@query("votes_folded", VOTES + " SELECT pid, round(sum(p1*0.5*pow(0.5,rn-1)),6) AS p1, round(sum(p2*0.5*pow(0.5,rn-1)),6) AS p2, count(*) AS votes FROM v GROUP BY pid")
def votes_folded(spark, sf):
    return rounded(sc.folded_votes(votes(spark, sf), ["pid"], "event_id", ["p1", "p2"], 0.5), "p1", "p2")


@query("votes_quantised", """WITH RECURSIVE v AS (SELECT user_id AS pid, value/500 AS p1, 1-value/500 AS p2, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT pid, i, floor((0.5::DOUBLE*p1)*255)/255 AS s1, floor((0.5::DOUBLE*p2)*255)/255 AS s2 FROM v WHERE i=1 UNION ALL
 SELECT v.pid, v.i, floor((0.5::DOUBLE*s1+0.5::DOUBLE*p1)*255)/255, floor((0.5::DOUBLE*s2+0.5::DOUBLE*p2)*255)/255 FROM r JOIN v ON v.pid=r.pid AND v.i=r.i+1)
SELECT pid, round(arg_max(s1,i),6) AS p1, round(arg_max(s2,i),6) AS p2, max(i) AS votes FROM r GROUP BY pid""")
def votes_quantised(spark, sf):
    return rounded(sc.folded_votes(votes(spark, sf), ["pid"], "event_id", ["p1", "p2"], 0.5, quantised=True, unbounded=True), "p1", "p2")


@query("votes_aligned", """WITH RECURSIVE v AS (SELECT user_id AS pid, value/500-0.3*(event_id%2) AS p1, 0.1+value/1000-0.2*(event_id%2) AS p2, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT pid, i, p1::DOUBLE AS s1, p2::DOUBLE AS s2 FROM v WHERE i=1 UNION ALL
 SELECT v.pid, v.i, 0.8::DOUBLE*s1+0.2::DOUBLE*p1*g, 0.8::DOUBLE*s2+0.2::DOUBLE*p2*g FROM r JOIN (SELECT *, 1 AS one FROM v) v ON v.pid=r.pid AND v.i=r.i+1 CROSS JOIN LATERAL (SELECT CASE WHEN s1*p1+s2*p2 < 0 THEN -1.0::DOUBLE ELSE 1.0 END AS g))
SELECT pid, round(arg_max(s1,i),6) AS p1, round(arg_max(s2,i),6) AS p2, max(i) AS votes FROM r GROUP BY pid""")
def votes_aligned(spark, sf):
    """Vectors of which every other one points away, some beyond 45 degrees."""
    turned = F.col("event_id") % 2
    v = table(spark, sf, "events").select(F.col("user_id").alias("pid"), "event_id", (F.col("value") / 500 - 0.3 * turned).alias("p1"), (0.1 + F.col("value") / 1000 - 0.2 * turned).alias("p2"))
    return rounded(sc.folded_votes(v, ["pid"], "event_id", ["p1", "p2"], 0.8, align_sign=True), "p1", "p2")


@query("votes_class", VOTES + """, s AS (SELECT pid, sum(p1*0.5*pow(0.5,rn-1)) AS p1, sum(p2*0.5*pow(0.5,rn-1)) AS p2 FROM v GROUP BY pid)
SELECT pid, CAST(CASE WHEN p1<=0 AND p2<=0 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END AS BIGINT) AS pred FROM s""")
def votes_class(spark, sf):
    state = sc.smoothed_votes(votes(spark, sf), ["pid"], "event_id", ["p1", "p2"], 0.5)
    return state.select("pid", sc.predicted_class(F.array("p1", "p2"), [0, 1, 2], [0]).cast("long").alias("pred"))


@query("votes_report", VOTES + """, s AS (SELECT pid, sum(p1*0.5*pow(0.5,rn-1)) AS p1, sum(p2*0.5*pow(0.5,rn-1)) AS p2 FROM v GROUP BY pid),
p AS (SELECT pid, CASE WHEN p1<=0 AND p2<=0 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END AS pred FROM s), t AS (SELECT user_id AS pid, CASE WHEN avg(value)>50 THEN 1 ELSE 2 END AS truth FROM events GROUP BY user_id),
l AS (SELECT unnest([0,1,2]) AS v) SELECT CAST(a.v AS BIGINT) AS truth, CAST(b.v AS BIGINT) AS pred, (SELECT count(*) FROM p JOIN t USING (pid) WHERE t.truth=a.v AND p.pred=b.v) AS n FROM l a, l b""")
def votes_report(spark, sf):
    truth = table(spark, sf, "events").groupBy(F.col("user_id").alias("pid")).agg(F.when(F.avg("value") > 50, 1).otherwise(2).alias("truth"))
    return longs(sc.vote_report(votes(spark, sf), ["pid"], "event_id", truth, [0, 1, 2], 0.5, [0]), "truth", "pred", "n")

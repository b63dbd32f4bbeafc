"""Queries of folds, ensembles, metrics, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.core import table
from tarmac.operators import folds
from tarmac.operators import raster as O
from tarmac.plans.catalog import R, query, r6
from tarmac.sources import fixtures as X

HASH = "(({0} * 2654435761) % 4294967296)"


def arithmetic_hash(c: str):
    """A hash that any engine can repeat: multiplication modulo 2 to the 32."""
    return (F.col(c) * F.lit(2654435761)) % F.lit(4294967296)


def _tiles(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("tile_id"), (F.col("label") % 4).alias("city"), F.col("label"))


TILES = "(SELECT vec_id AS tile_id, label % 4 AS city, label FROM embeddings)"

_ACC = f"(SELECT tile_id, k, {HASH.format('(tile_id*21+k)')} AS h FROM (SELECT DISTINCT tile_id FROM pix), range(0, 21) t(k))"


@query("crop_sample", f"""
WITH c AS (SELECT tile_id, k, h // 65536 % 5 AS ox, h // 1048576 % 5 AS oy FROM {_ACC}),
m AS (SELECT c.tile_id, k, ox, oy, count(*) FILTER (v > 0.05) AS hit FROM c JOIN pix p ON p.tile_id = c.tile_id AND p.x BETWEEN ox AND ox+3 AND p.y BETWEEN oy AND oy+3 GROUP BY ALL)
SELECT tile_id, k::INT AS k, ox::INT AS ox, oy::INT AS oy FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY CASE WHEN hit > 8 THEN k ELSE 100-k END) AS r FROM m) WHERE r = 1""")
def crop_sample(s, d):
    """The first of 21 hashed crops with more than eight bright pixels, else the last tried."""
    p = X.pix(s, d)
    c = p.select("tile_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("key", F.col("tile_id") * 21 + F.col("k")).withColumn("h", arithmetic_hash("key"))
    c = c.select("tile_id", "k", (F.floor(F.col("h") / 65536) % 5).cast("int").alias("ox"), (F.floor(F.col("h") / 1048576) % 5).cast("int").alias("oy"))
    rows = p.join(c, "tile_id").where(F.col("x").between(F.col("ox"), F.col("ox") + 3) & F.col("y").between(F.col("oy"), F.col("oy") + 3))
    hits = rows.groupBy("tile_id", "k", "ox", "oy").agg(F.count_if(F.col("v") > 0.05).alias("hit"))
    best = hits.groupBy("tile_id").agg(F.min_by(F.struct("k", "ox", "oy"), F.when(F.col("hit") > 8, F.col("k")).otherwise(100 - F.col("k"))).alias("b"))
    return best.select("tile_id", "b.k", "b.ox", "b.oy")


@query("fold_round_robin", f"SELECT tile_id, city, CAST((row_number() OVER (ORDER BY city, {HASH.format('tile_id')}, tile_id) - 1) % 4 AS INT) AS fold FROM {TILES}")
def fold_round_robin(s, d):
    """A counter over shuffled tiles of each city that runs on across cities."""
    return folds.round_robin(_shuffled(s, d), 4, "city", "h", "tile_id").select("tile_id", "city", "fold")


def _shuffled(s, d):
    return _tiles(s, d).withColumn("h", arithmetic_hash("tile_id"))


@query("fold_every_third", f"SELECT tile_id, city, CAST((row_number() OVER (PARTITION BY city ORDER BY tile_id) - 1) % 3 AS INT) AS fold FROM {TILES} WHERE label < 8")
def fold_every_third(s, d):
    """Folds of the training tiles of each city in the order of ids; labels 8 and 9 are the test source."""
    return folds.every_nth(_tiles(s, d).where("label < 8"), 3, "city", "tile_id").select("tile_id", "city", "fold")


@query("kfold_split", f"SELECT tile_id, city, ntile(4) OVER (PARTITION BY city ORDER BY {HASH.format('tile_id')}, tile_id)::INT AS fold FROM {TILES}")
def kfold_split(s, d):
    return folds.contiguous(_shuffled(s, d), 4, "city", "h", "tile_id").select("tile_id", "city", "fold")


@query("holdout_n", f"SELECT tile_id, city, row_number() OVER (PARTITION BY city ORDER BY {HASH.format('tile_id')}, tile_id) <= 20 AS val FROM {TILES}")
def holdout_n(s, d):
    return folds.held_out(_shuffled(s, d), 20, "city", "h", "tile_id").select("tile_id", "city", "val")


@query("ensemble_mean", f"SELECT tile_id, x, y, {R.format('avg(v)')} AS v FROM cube GROUP BY ALL HAVING count(*) = 4")
def ensemble_mean(s, d):
    """Mean of four members; a pixel that lacks one is an error."""
    rows = X.cube(s, d).groupBy(*O.KEY).agg(r6(F.avg("v")).alias("v"), F.count("*").alias("n"))
    return rows.select("tile_id", "x", "y", F.when(F.col("n") == 4, F.col("v")).otherwise(F.raise_error(F.lit("a member lacks a pixel")).cast("double")).alias("v"))


@query("ensemble_median", "SELECT tile_id, x, y, trunc(median(v*1000))::INT AS v FROM cube GROUP BY ALL")
def ensemble_median(s, d):
    return X.cube(s, d).groupBy(*O.KEY).agg(F.median(F.col("v") * 1000).cast("int").alias("v"))


@query("ensemble_weighted", f"SELECT tile_id, x, y, {R.format('sum(v*w)/sum(w)')} AS v FROM cube JOIN (VALUES (0,0,1),(0,1,2),(0,2,0),(0,3,5),(1,0,0),(1,1,1),(1,2,4),(1,3,2),(2,0,3),(2,1,1),(2,2,4),(2,3,1),(3,0,3),(3,1,6),(3,2,6),(3,3,2)) t(city, model, w) USING (city, model) GROUP BY ALL")
def ensemble_weighted(s, d):
    """Weights of each city and model over their sum; a model of weight 0, or without a pixel, adds nothing."""
    weights = [(0, 0, 1), (0, 1, 2), (0, 2, 0), (0, 3, 5), (1, 0, 0), (1, 1, 1), (1, 2, 4), (1, 3, 2), (2, 0, 3), (2, 1, 1), (2, 2, 4), (2, 3, 1), (3, 0, 3), (3, 1, 6), (3, 2, 6), (3, 3, 2)]
    w = s.createDataFrame(weights, "city int, model int, w int")
    whole = w.groupBy("city").agg(F.sum("w").alias("whole"))
    rows = X.cube(s, d).join(w, ["city", "model"]).groupBy("city", *O.KEY).agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return rows.join(whole, "city").select("tile_id", "x", "y", r6(F.col("s") / F.col("whole")).alias("v"))


@query("tta_mean", f"SELECT tile_id, x, y, {R.format('avg(v)')} AS v FROM (SELECT tile_id, x, y, v FROM pix UNION ALL SELECT tile_id, 7-x, y, v FROM pix UNION ALL SELECT tile_id, x, 7-y, v FROM pix UNION ALL SELECT tile_id, 7-x, 7-y, v FROM pix) GROUP BY ALL")
def tta_mean(s, d):
    """Mean over four flips, each undone on its output; here the same raster plays all four outputs."""
    flips = X.pix(s, d).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return O.dihedral(flips, F.col("k"), 8).groupBy(*O.KEY).agg(r6(F.avg("v")).alias("v"))


PT = "(SELECT a.tile_id, a.x, a.y, greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.v*2+0.5::DOUBLE)) AS p, (b.v > 0.05)::INT::DOUBLE AS t FROM pix a JOIN cube b ON b.model = 1 AND a.tile_id = b.tile_id AND a.x = b.x AND a.y = b.y)"


def prediction_truth(s, d):
    """(tile_id, x, y, p, t): a probability and a truth of 0 or 1 for each pixel."""
    b = X.cube(s, d).where("model = 1").select(*O.KEY, (F.col("v") > 0.05).cast("double").alias("t"))
    return X.pix(s, d).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") * 2 + 0.5))).join(b, O.KEY).select(*O.KEY, "p", "t")


@query("dice", f"SELECT tile_id, {R.format('CASE WHEN sum(p)+sum(t) = 0 THEN 1 ELSE 2*sum(p*t)/(sum(p)+sum(t)) END')} AS dice, {R.format('(2*sum(p*t)+1)/(sum(p)+sum(t)+1)')} AS smooth, {R.format('100*(2*sum((p > 0.5)::INT*t)+1)/(sum((p > 0.5)::INT)+sum(t)+1)')} AS rounded FROM {PT} GROUP BY tile_id")
def dice(s, d):
    hard = (F.col("p") > 0.5).cast("int")
    p, t, pt, h, ht = F.sum("p"), F.sum("t"), F.sum(F.col("p") * F.col("t")), F.sum(hard), F.sum(hard * F.col("t"))
    return prediction_truth(s, d).groupBy("tile_id").agg(r6(F.when(p + t == 0, 1.0).otherwise(2 * pt / F.nullif(p + t, F.lit(0.0)))).alias("dice"), r6((2 * pt + 1) / (p + t + 1)).alias("smooth"), r6(100 * (2 * ht + 1) / (h + t + 1)).alias("rounded"))


_C = "greatest(1e-7::DOUBLE, least(1-1e-7::DOUBLE, p))"
_B = f"avg(-(t*ln({_C})+(1-t)*ln(1-{_C})))"
_BS = f"avg(-((0.95::DOUBLE*t+0.05::DOUBLE*{_C})*ln({_C})+(1-(0.95::DOUBLE*t+0.05::DOUBLE*{_C}))*ln(1-{_C})))"


@query("bce", f"SELECT tile_id, {R.format(_B)} AS bce, {R.format(_BS)} AS soft, {R.format(f'0.75::DOUBLE*{_B}+0.25::DOUBLE*(1-(2*sum(p*t)+1)/(sum(p)+sum(t)+1))')} AS mixed FROM {PT} GROUP BY tile_id")
def bce(s, d):
    """Clipped cross entropy, its bootstrapped form, and its mixture with 1 - dice."""
    c = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    loss = lambda t: F.avg(-(t * F.log(c) + (1 - t) * F.log(1 - c)))
    smooth = (2 * F.sum(F.col("p") * F.col("t")) + 1) / (F.sum("p") + F.sum("t") + 1)
    return prediction_truth(s, d).groupBy("tile_id").agg(r6(loss(F.col("t"))).alias("bce"), r6(loss(0.95 * F.col("t") + 0.05 * c)).alias("soft"), r6(0.75 * loss(F.col("t")) + 0.25 * (1 - smooth)).alias("mixed"))


@query("multiclass_ce_accuracy", f"SELECT tile_id, {R.format('avg(-ln(q)) FILTER (c <> -100)')} AS loss, {R.format('avg(hit) FILTER (c <> -100)')} AS accuracy, {R.format('avg(CASE WHEN c = -100 THEN 1 ELSE hit END)')} AS lenient FROM (SELECT tile_id, x, y, c, max(q) FILTER (model = c % 4) AS q, (arg_max(model, (v, -model)) = max(c))::INT AS hit FROM (SELECT *, exp(v)/sum(exp(v)) OVER (PARTITION BY tile_id, x, y) AS q, CASE WHEN (x+y) % 5 = 4 THEN -100 ELSE (x+y) % 5 END AS c FROM cube) GROUP BY tile_id, x, y, c) GROUP BY tile_id")
def multiclass_ce_accuracy(s, d):
    """Log-loss and accuracy over pixels with a class, of equal scores the lower class; `lenient` counts pixels without one as right."""
    w = Window.partitionBy(*O.KEY)
    c = F.when((F.col("x") + F.col("y")) % 5 == 4, -100).otherwise((F.col("x") + F.col("y")) % 5)
    rows = X.cube(s, d).withColumn("q", F.exp("v") / F.sum(F.exp("v")).over(w)).withColumn("c", c)
    px = rows.groupBy(*O.KEY, "c").agg(F.max(F.when(F.col("model") == F.col("c"), F.col("q"))).alias("q"), F.max_by("model", F.struct("v", -F.col("model"))).alias("top")).withColumn("hit", (F.col("top") == F.col("c")).cast("int"))
    known = F.col("c") != -100
    return px.groupBy("tile_id").agg(r6(F.avg(F.when(known, -F.log("q")))).alias("loss"), r6(F.avg(F.when(known, F.col("hit")))).alias("accuracy"), r6(F.avg(F.when(known, F.col("hit")).otherwise(1))).alias("lenient"))


query("mean_squared", f"SELECT tile_id, {R.format('avg((p-t)*(p-t))')} AS mse FROM {PT} GROUP BY tile_id")(lambda s, d: prediction_truth(s, d).groupBy("tile_id").agg(r6(F.avg((F.col("p") - F.col("t")) * (F.col("p") - F.col("t")))).alias("mse")))


@query("masked_dice", f"WITH pt AS (SELECT * FROM {PT}), e AS (SELECT a.tile_id, a.x, a.y, min(b.t) AS m FROM pt a JOIN pt b ON a.tile_id = b.tile_id AND abs(a.x-b.x) IN (0, 1) AND abs(a.y-b.y) IN (0, 1) GROUP BY ALL) SELECT tile_id, {R.format('(2*sum(p*t*m)+1)/(sum(p*m)+sum(t*m)+1)')} AS dice FROM pt JOIN e USING (tile_id, x, y) GROUP BY tile_id")
def masked_dice(s, d):
    """Smoothed dice on the eroded truth only."""
    pt = prediction_truth(s, d)
    m = O.grey_erode(pt.withColumn("v", F.col("t")), 1).withColumnRenamed("v", "m")
    p, t = F.col("p") * F.col("m"), F.col("t") * F.col("m")
    return pt.join(m, O.KEY).groupBy("tile_id").agg(r6((2 * F.sum(p * F.col("t")) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("dice"))


@query("band_percentiles", f"SELECT city, x AS band, {R.format('avg(lo)')} AS lo, {R.format('avg(hi)')} AS hi FROM (SELECT city, tile_id, x, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pix GROUP BY ALL) GROUP BY ALL")
def band_percentiles(s, d):
    per = X.pix(s, d).groupBy("city", "tile_id", F.col("x").alias("band")).agg(F.percentile("v", [0.02, 0.98]).alias("q"))
    return per.groupBy("city", "band").agg(r6(F.avg(F.col("q")[0])).alias("lo"), r6(F.avg(F.col("q")[1])).alias("hi"))


@query("city_band_mean", f"SELECT city, x AS band, {R.format('avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v-lo)/(hi-lo))))')} AS mean FROM pix JOIN (SELECT tile_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pix WHERE v > 0 GROUP BY tile_id) USING (tile_id) GROUP BY ALL")
def city_band_mean(s, d):
    return O.stretch_percentile(X.pix(s, d), ["tile_id"], 0.02, 0.98).groupBy("city", F.col("x").alias("band")).agg(r6(F.avg("v")).alias("mean"))


@query("raster_stats_diff", f"SELECT city, count(*) AS n, {R.format('avg(hi1-hi0)')} AS diff, {R.format('avg(sd)')} AS sd FROM (SELECT city, tile_id, max(v) FILTER (model = 1) AS hi1, max(v) FILTER (model = 0) AS hi0, stddev_pop(v) FILTER (model = 0) AS sd FROM cube GROUP BY ALL) GROUP BY city")
def raster_stats_diff(s, d):
    per = X.cube(s, d).groupBy("city", "tile_id").agg(F.max(F.when(F.col("model") == 1, F.col("v"))).alias("b"), F.max(F.when(F.col("model") == 0, F.col("v"))).alias("a"), F.stddev_pop(F.when(F.col("model") == 0, F.col("v"))).alias("sd"))
    return per.groupBy("city").agg(F.count("*").alias("n"), r6(F.avg(F.col("b") - F.col("a"))).alias("diff"), r6(F.avg("sd")).alias("sd"))


@query("histogram_norm", f"SELECT bin::INT AS bin, {R.format('coalesce(n, 0)/whole')} AS share FROM range(0, 29) t(bin) LEFT JOIN (SELECT least(floor(p*29), 28)::BIGINT AS bin, count(*) AS n FROM {PT} GROUP BY 1) USING (bin), (SELECT count(*)::DOUBLE AS whole FROM pix)")
def histogram_norm(s, d):
    """29 equal bins on [0, 1], the last one closed, as shares; empty bins stay."""
    n = prediction_truth(s, d).groupBy(F.least(F.floor(F.col("p") * 29), F.lit(28)).alias("bin")).count()
    whole = n.agg(F.sum("count").alias("whole"))
    return s.range(29).select(F.col("id").alias("bin")).join(n, "bin", "left").join(F.broadcast(whole), how="cross").select(F.col("bin").cast("int").alias("bin"), r6(F.coalesce("count", F.lit(0)) / F.col("whole")).alias("share"))


@query("bounds", "SELECT trace_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(x)-min(x) AS w, max(y)-min(y) AS h FROM obs GROUP BY trace_id")
def bounds(s, d):
    return X.obs(s, d).groupBy("trace_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))


@query("degree", "SELECT node_id, (SELECT count(*) FROM edges WHERE src = node_id) AS outgoing, (SELECT count(*) FROM edges WHERE dst = node_id) AS incoming, (SELECT count(*) FROM edges WHERE src = node_id OR dst = node_id) AS incident FROM nodes")
def degree(s, d):
    e = X.edges(s, d)
    ends = e.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    n = ends.groupBy("node_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count("*").alias("incident"))
    return X.nodes(s, d).select("node_id").join(n, "node_id", "left").na.fill(0)


@query("line_sampled_confidence", f"""
WITH g AS (SELECT s.tile_id, line_id, pos, unnest(range(0, 5)) AS k, x, y, x1, y1 FROM segs s WHERE tile_id IN (SELECT tile_id FROM pix)),
c AS (SELECT tile_id, line_id, pos, floor((x+(x1-x)*k/4.0::DOUBLE)/162.5::DOUBLE)::INT AS x, floor((y+(y1-y)*k/4.0::DOUBLE)/162.5::DOUBLE)::INT AS y FROM g)
SELECT tile_id, line_id, {R.format('avg(v)')} AS confidence, count(*) AS n FROM c JOIN pix USING (tile_id, x, y) GROUP BY ALL""")
def line_sampled_confidence(s, d):
    """Mean raster value at five places of every segment of a line."""
    g = X.segs(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / 4.0) / 162.5).cast("int")
    c = g.select("tile_id", "line_id", at("x", "x1").alias("x"), at("y", "y1").alias("y"))
    return c.join(X.pix(s, d), O.KEY).groupBy("tile_id", "line_id").agg(r6(F.avg("v")).alias("confidence"), F.count("*").alias("n"))


@query("epoch_metrics", f"SELECT l_linenumber AS epoch, {R.format('avg(l_discount)')} AS loss, {R.format('avg(l_quantity)')} AS acc, avg(l_discount) = min(avg(l_discount)) OVER () AS best FROM lineitem GROUP BY l_linenumber")
def epoch_metrics(s, d):
    """Means of each epoch, and whether it has the least loss; the epochs are few, so one window over them is fine."""
    e = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.avg("l_discount").alias("loss"), F.avg("l_quantity").alias("acc"))
    least = e.agg(F.min("loss").alias("least"))
    return e.join(F.broadcast(least), how="cross").select("epoch", r6(F.col("loss")).alias("loss"), r6(F.col("acc")).alias("acc"), (F.col("loss") == F.col("least")).alias("best"))


_K = "(SELECT tile_id, x, y, model, row_number() OVER (PARTITION BY tile_id, x, y ORDER BY v DESC, model) AS r FROM cube)"


@query("precision_at_k", f"SELECT tile_id, {R.format('100*avg((r <= 1)::INT)')} AS p1, {R.format('100*avg((r <= 2)::INT)')} AS p2, {R.format('100*avg((r <= 3)::INT)')} AS p3 FROM {_K} WHERE model = (x + y) % 4 GROUP BY tile_id")
def precision_at_k(s, d):
    rank = F.row_number().over(Window.partitionBy(*O.KEY).orderBy(F.desc("v"), "model"))
    rows = X.cube(s, d).withColumn("r", rank).where(F.col("model") == (F.col("x") + F.col("y")) % 4)
    return rows.groupBy("tile_id").agg(*[r6(100 * F.avg((F.col("r") <= k).cast("int"))).alias(f"p{k}") for k in (1, 2, 3)])


@query("top_k_per_key", f"SELECT tile_id, y, max(x) FILTER (r = 1) AS c1, max(v) FILTER (r = 1) AS v1, max(x) FILTER (r = 2) AS c2, max(v) FILTER (r = 2) AS v2, max(x) FILTER (r = 5) AS c5, max(v) FILTER (r = 5) AS v5 FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, y ORDER BY v DESC, x) AS r FROM pix) WHERE r <= 5 GROUP BY ALL")
def top_k_per_key(s, d):
    rank = F.row_number().over(Window.partitionBy("tile_id", "y").orderBy(F.desc("v"), "x"))
    rows = X.pix(s, d).withColumn("r", rank).where("r <= 5")
    cols = [F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{n}{k}") for k in (1, 2, 5) for c, n in (("x", "c"), ("v", "v"))]
    return rows.groupBy("tile_id", "y").agg(*cols)


query("ordered_listing", f"SELECT tile_id, city, label FROM {TILES} ORDER BY city, tile_id")(lambda s, d: _tiles(s, d).orderBy("city", "tile_id"))
query("best_per_group", "SELECT tile_id, y, arg_max(x, v) AS best_x, max(v) AS v FROM pix GROUP BY ALL")(lambda s, d: X.pix(s, d).groupBy("tile_id", "y").agg(F.max_by("x", F.when(F.col("v").isNotNull(), F.struct("v", -F.col("x")))).alias("best_x"), F.max("v").alias("v")))
query("limit", "SELECT trace_id, ts, x FROM (SELECT *, dense_rank() OVER (ORDER BY trace_id) AS r FROM (SELECT * FROM obs WHERE trace_id IN (SELECT DISTINCT trace_id FROM obs ORDER BY 1 LIMIT 10))) WHERE r <= 10")(
    lambda s, d: X.obs(s, d).join(F.broadcast(X.obs(s, d).select("trace_id").distinct().orderBy("trace_id").limit(10)), "trace_id", "left_semi").select("trace_id", "ts", "x"))
query("union_all", "SELECT tile_id, line_id, pos, x, y FROM lines UNION ALL SELECT trace_id, -1, 0, floor(x)::BIGINT, floor(y)::BIGINT FROM obs")(
    lambda s, d: X.lines(s, d).unionByName(X.obs(s, d).select(F.col("trace_id").alias("tile_id"), F.lit(-1).cast("long").alias("line_id"), F.lit(0).alias("pos"), F.floor("x").cast("long").alias("x"), F.floor("y").cast("long").alias("y"))))
query("truth_by_tile", f"SELECT doc_id, quality, toxic, city, {R.format('(v*100)')} AS v FROM labels JOIN {TILES} t ON t.tile_id = doc_id JOIN (SELECT tile_id, sum(v) AS v FROM pix GROUP BY 1) p ON p.tile_id = doc_id")(
    lambda s, d: table(s, d, "labels").join(_tiles(s, d).withColumnRenamed("tile_id", "doc_id"), "doc_id").join(X.pix(s, d).groupBy(F.col("tile_id").alias("doc_id")).agg(F.sum("v").alias("v")), "doc_id").select("doc_id", "quality", "toxic", "city", r6(F.col("v") * 100).alias("v")))
query("semi_anti_filters", "SELECT tile_id, x, y, v, (tile_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS bad FROM pix WHERE tile_id IN (SELECT doc_id FROM labels)")(
    lambda s, d: _semi_anti(X.pix(s, d).drop("city"), table(s, d, "labels")))


def _semi_anti(p, labels):
    known, bad = labels.select(F.col("doc_id").alias("tile_id")), labels.where("toxic = 1").select(F.col("doc_id").alias("tile_id"))
    kept = p.join(known, "tile_id", "left_semi")
    return kept.join(bad, "tile_id", "left_anti").withColumn("bad", F.lit(False)).unionByName(kept.join(bad, "tile_id", "left_semi").withColumn("bad", F.lit(True)))

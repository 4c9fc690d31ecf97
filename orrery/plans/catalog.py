"""The engine's registered queries over ``embeddings``, and the SQL that each must agree with.

Search queries are the rows whose id is divisible by 20, against all rows.
Distances are compared to nine decimals and reported to six.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.functions.metrics import mean_recall, percentiles, recall_at_k
from orrery.operators import clustering as C
from orrery.operators import graph as G
from orrery.operators import quantize as Q
from orrery.operators.knn import against, knn_join, nearest_points, ranked
from orrery.plans.index import IndexConfig, VectorIndex

K, RATIO, REPLICAS, LIMIT, PROBES, CHECK = 10, 0.05, 8, 118, 8, 400
Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

# --- SQL that several queries share ----------------------------------------------------------------------------------

E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
QS = "q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 20 = 0)"
HEADS = f"h AS (SELECT vec_id AS head_id, v AS hv FROM e WHERE vec_id % {round(1 / RATIO)} = 0)"


def ip(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def l2(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"


ASSIGNED = f"""a AS (SELECT head_id, vec_id, d AS head_dist, rank AS head_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY vec_id ORDER BY d, head_id) AS rank FROM (SELECT head_id, vec_id, {l2("v", "hv")} AS d FROM e, h))
  WHERE rank <= {REPLICAS})"""
POSTINGS = f"""p AS (SELECT * FROM (SELECT head_id, vec_id, head_dist, row_number() OVER
  (PARTITION BY head_id ORDER BY head_dist, vec_id) AS pos FROM a) WHERE pos <= {LIMIT})"""


def index_sql(probes: int = PROBES, check: int = CHECK) -> str:
    """Probed heads (b) and candidates (c) of each query, after the tables that they need."""
    probed = f"""b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, head_id) AS head_rank
  FROM (SELECT query_id, head_id, {l2("qv", "hv")} AS d FROM q, h)) WHERE head_rank <= {probes})"""
    candidates = f"""c AS (SELECT query_id, vec_id, head_id FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY head_rank, pos) AS n FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id, vec_id ORDER BY head_rank, pos) AS once FROM b JOIN p USING (head_id)) WHERE once = 1)
  WHERE n <= {check})"""
    return ", ".join((E, QS, HEADS, ASSIGNED, POSTINGS, probed, candidates))


INDEX = index_sql()


def found_sql(name: str = "f", among: str = "c") -> str:
    """The K nearest of the candidates, by exact distance."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM
  (SELECT query_id, vec_id, {l2("qv", "v")} AS d FROM {among} JOIN q USING (query_id) JOIN e USING (vec_id))) WHERE rank <= {K})"""


FOUND = found_sql()


def codes_sql(bits: int, rows: str) -> str:
    """z (head_id, vec_id, v, c, x, n and factors) from ``rows``, a query of head_id, vec_id, v and its centroid c.

    The scale is the one of all places where a code steps up that makes the code most parallel to the residual.
    """
    half, top = 1 << (bits - 1), (1 << (bits - 1)) - 1
    sign = "CASE WHEN y[1] >= 0 THEN {half} + y[2] ELSE {half} - 1 - y[2] END".format(half=half)
    scaled = f"""zs AS (SELECT *, list_transform(r, lambda y: abs(y) / CASE WHEN sqrt({ip('r', 'r')}) > 1e-12 THEN sqrt({ip('r', 'r')}) ELSE 1 END) AS a FROM zr)"""
    if top:
        best = f"""zu AS (SELECT head_id, vec_id, unnest(a) AS a, generate_subscripts(a, 1) AS i, 0.5 * list_sum(a) AS base, 0.25 * len(a) AS square FROM zs),
zw AS (SELECT head_id, vec_id, j / a AS t, base / sqrt(square) AS start, (base + sum(a) OVER w) / sqrt(square + sum(2.0 * j) OVER w) AS quotient
  FROM zu, range(1, {top + 1}) s(j) WHERE a > 0 WINDOW w AS (PARTITION BY head_id, vec_id ORDER BY j / a, i, j ROWS UNBOUNDED PRECEDING)),
zt AS (SELECT head_id, vec_id, CASE WHEN max(quotient) >= any_value(start) THEN arg_max(t, quotient) ELSE 0 END AS t FROM zw GROUP BY head_id, vec_id),
zm AS (SELECT zs.*, list_transform(a, lambda y: least(floor(coalesce(t, 0) * y + 1e-9), {top})) AS g FROM zs LEFT JOIN zt USING (head_id, vec_id))"""
    else:
        best = "zm AS (SELECT *, list_transform(a, lambda y: 0) AS g FROM zs)"
    return f"""zr AS (SELECT *, list_transform(list_zip(v, c), lambda y: y[1] - y[2]) AS r FROM ({rows})), {scaled}, {best},
zx AS (SELECT *, list_transform(list_zip(r, g), lambda y: ({sign}) - {(2 * half - 1) / 2}::DOUBLE) AS x FROM zm),
zp AS (SELECT *, {ip('r', 'r')} AS n, {ip('r', 'x')} AS p, {ip('x', 'x')} AS xx FROM zx),
zf AS (SELECT *, CASE WHEN abs(p) > 1e-12 THEN n / p ELSE 0 END AS ratio FROM zp),
z AS (SELECT head_id, vec_id, v, c, x, CAST(CAST(n + 2 * ratio * {ip('c', 'x')} AS FLOAT) AS DOUBLE) AS f_add, CAST(CAST(-2 * ratio AS FLOAT) AS DOUBLE) AS f_rescale,
  CAST(CAST(n AS FLOAT) AS DOUBLE) AS r_square, CAST(CAST({ip('r', 'c')} AS FLOAT) AS DOUBLE) AS r_dot_c, CAST(CAST(CASE WHEN xx > 0 THEN p / xx ELSE 0 END AS FLOAT) AS DOUBLE) AS scale FROM zf)"""


CODED_ROWS = "SELECT head_id, vec_id, v, hv AS c FROM p JOIN h USING (head_id) JOIN e USING (vec_id)"
AWAY = "list_transform(list_zip(qv, c), lambda y: y[1] - y[2])"
ESTIMATED = {
    "l2": f"f_add + {ip(AWAY, AWAY)} + f_rescale * {ip('qv', 'x')}",
    "ip": f"-({ip('c', 'qv')} + r_dot_c - f_rescale / 2 * {ip(AWAY, 'x')})",
}


def coded_search_sql(bits: int, name: str, take: int, probes: int = PROBES) -> str:
    """``name``: the ``take`` nearest candidates by estimate."""
    return f"""{index_sql(probes)}, {codes_sql(bits, CODED_ROWS)}, {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM
  (SELECT query_id, vec_id, {ESTIMATED['l2']} AS d FROM c JOIN q USING (query_id) JOIN z USING (head_id, vec_id))) WHERE rank <= {take})"""


def recall_sql(found: str) -> str:
    """n_queries and mean recall of table ``found`` against t."""
    return f"""SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall FROM (SELECT t.query_id, count(f.vec_id) / {K}.0 AS recall
FROM t LEFT JOIN {found} f ON t.query_id = f.query_id AND t.vec_id = f.vec_id GROUP BY t.query_id)"""


def settings_sql(rows: list[tuple[str, str]]) -> str:
    """A row a setting, each of its own WITH."""
    return " UNION ALL ".join(f"SELECT {named}, * FROM (WITH {body})" for named, body in rows)


def knn_sql(distance: str) -> str:
    return f"""t AS (SELECT query_id, vec_id, d, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT query_id, vec_id, {distance} AS d FROM q, e)) WHERE rank <= {K})"""


TRUE = knn_sql(l2("qv", "v"))
CENTER = """m AS (SELECT list(x ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS x FROM
  (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos))"""
ONE_BIT = f"""o AS (SELECT vec_id, r, c, x, {ip("r", "r")} AS n, {ip("r", "x")} AS p, {ip("c", "x")} AS m FROM
  (SELECT *, list_transform(r, lambda y: CASE WHEN y > 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS x FROM
  (SELECT vec_id, c, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r FROM e, m))),
g AS (SELECT vec_id, x, c, n + 2 * m * n / p AS f_add, -2 * n / p AS f_rescale,
  3.8 * sqrt(n) * sqrt(greatest((n * len(x) * 0.25 / (p * p) - 1) / (len(x) - 1), 0)) AS f_error FROM o)"""
ESTIMATE = f"""s AS (SELECT query_id, vec_id, f_add + {ip("qc", "qc")} + f_rescale * {ip("qv", "x")} AS d FROM
  (SELECT query_id, qv, list_transform(list_zip(qv, c), lambda z: z[1] - z[2]) AS qc FROM q, m), g)"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``; an own one only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="orrery-index-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def stated(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") % 20 == 0).select("vec_id", "embedding")


def heads_of(e: DataFrame) -> DataFrame:
    return C.strided(e.select("vec_id", "embedding"), RATIO)


def six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def reported(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "vec_id", *six("distance"), F.col("rank").cast("int").alias("rank"))


def shown(table: str) -> str:
    return f"SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM {table}"


def elements(v: str = "value") -> list:
    return [F.col("pos").cast("int").alias("pos"), F.round("x", 6).alias(v)]


# --- exact search and vector functions --------------------------------------------------------------------------------


@query("knn_l2", f"WITH {E}, {QS}, {TRUE} {shown('t')}")
def knn_l2(spark, d):
    return reported(knn_join(stated(emb(spark, d)), emb(spark, d), K))


@query("knn_ip", f"WITH {E}, {QS}, {knn_sql('round(-' + ip('qv', 'v') + ', 9)')} {shown('t')}")
def knn_ip(spark, d):
    return reported(knn_join(stated(emb(spark, d)), emb(spark, d), K, "ip"))


@query("knn_cosine", f"WITH {E}, {QS}, {knn_sql('round(1 - ' + ip('qv', 'v') + ' / sqrt(' + ip('qv', 'qv') + ' * ' + ip('v', 'v') + '), 9)')} {shown('t')}")
def knn_cosine(spark, d):
    return reported(knn_join(stated(emb(spark, d)), emb(spark, d), K, "cosine"))


@query("vector_norms", f"WITH {E} SELECT vec_id, CAST(len(v) AS INT) AS dim, round(sqrt({ip('v', 'v')}), 6) AS norm FROM e")
def vector_norms(spark, d):
    return emb(spark, d).select("vec_id", F.size("embedding").alias("dim"), F.round(V.norm("embedding"), 6).alias("norm"))


@query("normalize_vectors", f"""WITH {E}, n AS (SELECT vec_id, v, sqrt({ip('v', 'v')}) AS n FROM e)
SELECT vec_id, CAST(pos - 1 AS INT) AS pos, round(CASE WHEN n > 1e-10 THEN x / n ELSE x END, 6) AS value FROM
(SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n)""")
def normalize_vectors(spark, d):
    return emb(spark, d).select("vec_id", F.posexplode(V.normalized("embedding")).alias("pos", "x")).select("vec_id", *elements())


@query("distance_pairs", f"""WITH {E} SELECT a.vec_id, b.vec_id AS other_id, round({l2('a.v', 'b.v')}, 6) AS l2,
round({ip('a.v', 'b.v')}, 6) AS ip FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def distance_pairs(spark, d):
    a = emb(spark, d).select("vec_id", F.col("embedding").alias("x"))
    b = emb(spark, d).select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("y"))
    both = a.join(b, F.col("other_id") == F.col("vec_id") + 1)
    return both.select("vec_id", "other_id", F.round(V.l2_distance("x", "y"), 6).alias("l2"), F.round(V.dot("x", "y"), 6).alias("ip"))


def means(e: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """Element-wise means of each group: pre-aggregated by place before the shuffle."""
    return e.select(*by, F.posexplode(V.doubles(vec)).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))


def mean_vectors(e: DataFrame, by: list[str], name: str = "centroid", vec: str = "embedding") -> DataFrame:
    """The means as one array for each group."""
    parts = means(e, by, vec).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return parts.select(*by, F.col("p.x").alias(name))


@query("global_centroid", f"WITH {E} SELECT CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS value FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos")
def global_centroid(spark, d):
    return means(emb(spark, d), []).select(*elements())


@query("label_centroids", f"WITH {E} SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY label, pos")
def label_centroids(spark, d):
    return means(emb(spark, d), ["label"]).select("label", *elements())


BY_LABEL = """l AS (SELECT label AS cluster, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM
  (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY label, pos) GROUP BY label)"""
NEAREST = f"n AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT vec_id, cluster, {l2('v', 'c')} AS d FROM e, l) GROUP BY vec_id)"


def nearest_label(spark, d) -> DataFrame:
    e = emb(spark, d)
    centers = mean_vectors(e, ["label"])
    near = nearest_points(e, centers, 1, point_id="label", point_vec="centroid")
    return near.select(F.col("query_id").alias("vec_id"), F.col("vec_id").cast("int").alias("cluster"), F.col("distance").alias("d"))


@query("nearest_centroid", f"WITH {E}, {BY_LABEL}, {NEAREST} SELECT vec_id, CAST(cluster AS INT) AS cluster, round(d, 6) AS distance FROM n")
def nearest_centroid(spark, d):
    return nearest_label(spark, d).select("vec_id", "cluster", F.round("d", 6).alias("distance"))


@query("kmeans_one_iteration", f"""WITH {E}, {BY_LABEL}, {NEAREST} SELECT CAST(cluster AS INT) AS cluster, CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS value
FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n JOIN e USING (vec_id)) GROUP BY cluster, pos""")
def kmeans_one_iteration(spark, d):
    joined = nearest_label(spark, d).join(emb(spark, d).select("vec_id", "embedding"), "vec_id")
    return means(joined, ["cluster"]).select("cluster", *elements())


@query("cluster_balance", f"""WITH {E}, {BY_LABEL}, {NEAREST}, k AS (SELECT l.cluster, count(n.vec_id) AS size FROM l LEFT JOIN n USING (cluster) GROUP BY l.cluster)
SELECT max(size) AS most, min(size) FILTER (WHERE size > 0) AS least, round(avg(size), 6) AS mean, round(stddev_pop(size) / avg(size), 6) AS balance FROM k""")
def cluster_balance(spark, d):
    labels = emb(spark, d).select(F.col("label").alias("cluster")).distinct()
    size = labels.join(nearest_label(spark, d).groupBy("cluster").count(), "cluster", "left").select(F.coalesce("count", F.lit(0)).alias("size"))
    return size.agg(
        F.max("size").alias("most"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.round(F.avg("size"), 6).alias("mean"), F.round(F.stddev_pop("size") / F.avg("size"), 6).alias("balance"),
    )


@query("kmeans_objective", f"WITH {E}, {BY_LABEL}, {NEAREST} SELECT count(*) AS n, round(sum(d), 5) AS objective FROM n")
def kmeans_objective(spark, d):
    return nearest_label(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 5).alias("objective"))


@query("dim_variance_topk", f"""WITH {E} SELECT CAST(pos - 1 AS INT) AS pos, round(m, 6) AS mean, round(s, 6) AS variance FROM (SELECT pos, avg(x) AS m, var_pop(x) AS s
FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos) ORDER BY round(s, 9) DESC, pos LIMIT 5""")
def dim_variance_topk(spark, d):
    each = emb(spark, d).select(F.posexplode(V.doubles("embedding")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    return each.orderBy(F.round("variance", 9).desc(), "pos").limit(5).select(F.col("pos").cast("int").alias("pos"), *six("mean", "variance"))


@query("kd_split_dim", f"""WITH {E}, u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
t AS (SELECT pos, var_pop(x) AS s, quantile_disc(x, 0.5) AS median FROM u GROUP BY pos)
SELECT CAST(pos - 1 AS INT) AS pos, round(s, 6) AS variance, round(median, 6) AS median FROM t ORDER BY round(s, 9) DESC, pos LIMIT 1""")
def kd_split_dim(spark, d):
    u = emb(spark, d).select(F.posexplode(V.doubles("embedding")).alias("pos", "x"))
    each = u.groupBy("pos").agg(F.var_pop("x").alias("variance"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("median"))
    return each.orderBy(F.round("variance", 9).desc(), "pos").limit(1).select(F.col("pos").cast("int").alias("pos"), *six("variance", "median"))


@query("medoids", f"""WITH {E}, s AS (SELECT a.label, a.vec_id, round(sum({l2('a.v', 'b.v')}), 6) AS total FROM e a JOIN e b ON a.label = b.label GROUP BY a.label, a.vec_id)
SELECT CAST(label AS INT) AS label, arg_min(vec_id, (total, vec_id)) AS vec_id, round(min(total), 3) AS total FROM s GROUP BY label""")
def medoids(spark, d):
    """Sums of squared distances need no pairs: n|x|^2 + sum|y|^2 - 2 <x, sum y>."""
    e = emb(spark, d).withColumn("sq", V.dot("embedding", "embedding"))
    sums = mean_vectors(e, ["label"], "mean").join(e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("sq").alias("sq_sum")), "label")
    total = F.round(F.col("n") * F.col("sq") + F.col("sq_sum") - 2 * F.col("n") * V.dot("embedding", "mean"), 6)
    each = e.join(F.broadcast(sums) if sums.count() < 10_000 else sums, "label").withColumn("total", total)
    best = each.groupBy("label").agg(F.min(F.struct("total", "vec_id")).alias("b"))
    return best.select("label", F.col("b.vec_id").alias("vec_id"), F.round("b.total", 3).alias("total"))


# --- index ------------------------------------------------------------------------------------------------------------


@query("strided_sample", f"WITH {E}, {HEADS} SELECT head_id AS vec_id FROM h")
def strided_sample(spark, d):
    return heads_of(emb(spark, d)).select("vec_id")


@query("head_assign", f"WITH {E}, {HEADS}, {ASSIGNED} SELECT vec_id, head_id, round(head_dist, 6) AS head_dist, CAST(head_rank AS INT) AS head_rank FROM a")
def head_assign(spark, d):
    near = nearest_points(emb(spark, d), heads_of(emb(spark, d)), REPLICAS)
    return near.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("head_id"), F.round("distance", 6).alias("head_dist"), F.col("rank").cast("int").alias("head_rank"))


def postings_of(e: DataFrame) -> DataFrame:
    return C.assign_postings(e, heads_of(e), REPLICAS, LIMIT)


@query("posting_prune", f"WITH {E}, {HEADS}, {ASSIGNED}, {POSTINGS} SELECT head_id, CAST(pos AS INT) AS pos, vec_id, round(head_dist, 6) AS head_dist FROM p")
def posting_prune(spark, d):
    return postings_of(emb(spark, d)).select("head_id", F.col("pos").cast("int").alias("pos"), "vec_id", *six("head_dist"))


@query("posting_stats", f"""WITH {E}, {HEADS}, {ASSIGNED}, {POSTINGS}, k AS (SELECT head_id, count(*) AS n FROM p GROUP BY head_id)
SELECT count(*) AS n_postings, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean,
(SELECT count(DISTINCT vec_id) FROM p) AS n_vectors, round(sum(n) / (SELECT count(DISTINCT vec_id) FROM p), 6) AS replicas FROM k""")
def posting_stats(spark, d):
    e = emb(spark, d)
    return VectorIndex(config(), e, heads_of(e), postings_of(e)).posting_stats()


@query("rearrange_postings", f"""WITH {E}, {HEADS}, {ASSIGNED}, {POSTINGS} SELECT head_id, vec_id, CAST(row_number() OVER
(PARTITION BY head_id ORDER BY round(-{ip('v', 'hv')}, 9), vec_id) AS INT) AS pos FROM p JOIN h USING (head_id) JOIN e USING (vec_id)""")
def rearrange_postings(spark, d):
    e = emb(spark, d)
    h = heads_of(e).select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("hv"))
    rows = postings_of(e).select("head_id", "vec_id").join(h, "head_id").join(e.select("vec_id", "embedding"), "vec_id")
    order = Window.partitionBy("head_id").orderBy(F.round(V.neg_ip("embedding", "hv"), 9), "vec_id")
    return rows.select("head_id", "vec_id", F.row_number().over(order).alias("pos"))


def config(**more) -> IndexConfig:
    return IndexConfig(**({"ratio": RATIO, "replicas": REPLICAS, "posting_limit": LIMIT, "probes": PROBES, "max_check": CHECK, "heads": "strided"} | more))


def index_of(spark, d, **more) -> VectorIndex:
    """Postings are cut as in posting_prune: by the limit alone."""
    e = emb(spark, d)
    return VectorIndex(config(**more), e.select("vec_id", "embedding"), heads_of(e), postings_of(e))


@query("head_probe", f"WITH {INDEX} SELECT query_id, head_id, CAST(head_rank AS INT) AS head_rank FROM b")
def head_probe(spark, d):
    return index_of(spark, d).probed(stated(emb(spark, d))).select("query_id", "head_id", F.col("head_rank").cast("int").alias("head_rank"))


@query("ivf_search", f"WITH {INDEX}, {FOUND} {shown('f')}")
def ivf_search(spark, d):
    return reported(index_of(spark, d).search(stated(emb(spark, d)), K))


@query("search_candidates", f"WITH {INDEX} SELECT query_id, vec_id, head_id FROM c")
def search_candidates(spark, d):
    return index_of(spark, d).candidates(stated(emb(spark, d))).select("query_id", "vec_id", "head_id")


@query("search_stats", f"""WITH {INDEX}, r AS (SELECT query_id, count(DISTINCT head_id) AS n_postings, count(*) AS n_rows,
CAST(sum(4 * len(qv) + 8) AS BIGINT) AS n_bytes FROM b JOIN p USING (head_id) JOIN q USING (query_id) GROUP BY query_id)
SELECT query_id, n_postings, n_rows, n_bytes, n_checked FROM r JOIN (SELECT query_id, count(*) AS n_checked FROM c GROUP BY query_id) USING (query_id)""")
def search_stats(spark, d):
    return index_of(spark, d).search_stats(stated(emb(spark, d)))


@query("ann_recall", f"""WITH {INDEX}, {FOUND}, {TRUE} SELECT t.query_id, round(count(f.vec_id) / {K}.0, 6) AS recall
FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.vec_id = f.vec_id GROUP BY t.query_id""")
def ann_recall(spark, d):
    e, i = emb(spark, d), index_of(spark, d)
    return recall_at_k(i.search(stated(e), K), knn_join(stated(e), e, K), K).select("query_id", *six("recall"))


@query("index_recall")
def index_recall(spark, d):
    """Mean recall of the tuned index (tree heads, all replicas) against brute force; 0.9 is the floor."""
    e = emb(spark, d).select("vec_id", "embedding")
    heads = C.select_heads(e, RATIO)
    limit = round(REPLICAS / RATIO)
    i = VectorIndex(config(probes=24, max_check=1 << 20), e, heads, C.assign_postings(e, heads, REPLICAS, limit, spill=True))
    return mean_recall(i.search(stated(e), K), knn_join(stated(e), e, K), K)


@query("delta_encode", f"""WITH {E}, {HEADS}, {ASSIGNED}, {POSTINGS}, x AS (SELECT head_id, vec_id, list_transform(list_zip(v, hv), lambda z: z[1] - z[2]) AS w
FROM p JOIN h USING (head_id) JOIN e USING (vec_id)) SELECT head_id, vec_id, round(list_sum(w), 6) AS total, round({ip('w', 'w')}, 6) AS square FROM x""")
def delta_encode(spark, d):
    rows = gathered(spark, d).withColumn("w", V.minus("embedding", "centroid"))
    return rows.select("head_id", "vec_id", F.round(V.total(F.col("w")), 6).alias("total"), F.round(V.dot("w", "w"), 6).alias("square"))


def gathered(spark, d) -> DataFrame:
    """Postings with their vectors and heads' vectors (``centroid``)."""
    e = emb(spark, d)
    h = heads_of(e).select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("centroid"))
    return postings_of(e).join(h, "head_id").join(e.select("vec_id", "embedding"), "vec_id")


@query("delta_roundtrip", f"WITH {E}, {HEADS}, {ASSIGNED}, {POSTINGS} SELECT count(*) AS n, 0.0::DOUBLE AS worst FROM p")
def delta_roundtrip(spark, d):
    rows = gathered(spark, d).withColumn("back", V.plus(V.minus("embedding", "centroid"), F.col("centroid")))
    worst = F.array_max(F.transform(V.minus("back", "embedding"), lambda x: F.abs(x)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(worst), 9).alias("worst"))


@query("delta_search", f"WITH {INDEX}, {FOUND} {shown('f')}")
def delta_search(spark, d):
    i = index_of(spark, d, delta=True)
    i.postings = gathered(spark, d).withColumn("delta", V.minus("embedding", "centroid")).drop("embedding", "centroid")
    return reported(i.search(stated(emb(spark, d)), K))


# --- quantizers -------------------------------------------------------------------------------------------------------


def coded(spark, d) -> DataFrame:
    e = emb(spark, d).select("vec_id", "embedding")
    center = mean_vectors(e, [])  # one row
    return Q.one_bit(e.crossJoin(F.broadcast(center)))


@query("onebit_codes", f"WITH {E}, {CENTER}, {ONE_BIT} SELECT vec_id, array_to_string(list_transform(x, lambda y: CASE WHEN y > 0 THEN '1' ELSE '0' END), '') AS code FROM g")
def onebit_codes(spark, d):
    return coded(spark, d).select("vec_id", F.array_join(F.transform("code", lambda b: b.cast("string")), "").alias("code"))


@query("onebit_factors", f"WITH {E}, {CENTER}, {ONE_BIT} SELECT vec_id, round(f_add, 6) AS f_add, round(f_rescale, 6) AS f_rescale, round(f_error, 6) AS f_error FROM g")
def onebit_factors(spark, d):
    return coded(spark, d).select("vec_id", *six("f_add", "f_rescale", "f_error"))


@query("packed_sign_bytes", f"""WITH {E}, {CENTER}, {ONE_BIT}, b AS (SELECT vec_id, CAST((pos - 1) // 8 AS INT) AS byte, CASE WHEN y > 0 THEN 1 << CAST((pos - 1) % 8 AS INT) ELSE 0 END AS bit
FROM (SELECT vec_id, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM g)) SELECT vec_id, byte, CAST(sum(bit) AS INT) AS value FROM b GROUP BY vec_id, byte""")
def packed_sign_bytes(spark, d):
    return coded(spark, d).select("vec_id", F.posexplode(V.packed(F.col("code"))).alias("byte", "value"))


def estimates(spark, d) -> DataFrame:
    q = stated(emb(spark, d)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pairs = against(coded(spark, d), q)
    return pairs.withColumn("estimate", Q.one_bit_l2()).withColumn("exact", V.l2_distance("query_vec", "embedding"))


@query("onebit_distance_l2", f"WITH {E}, {QS}, {CENTER}, {ONE_BIT}, {ESTIMATE} SELECT query_id, vec_id, round(d, 5) AS estimate FROM s")
def onebit_distance_l2(spark, d):
    return estimates(spark, d).select("query_id", "vec_id", F.round("estimate", 5).alias("estimate"))


@query("onebit_distance_ip", f"WITH {E}, {QS}, {CENTER}, {ONE_BIT} SELECT query_id, vec_id, round(-{ip('c', 'qv')} + f_rescale / 2 * {ip('qv', 'x')}, 5) AS estimate FROM q, g")
def onebit_distance_ip(spark, d):
    return estimates(spark, d).select("query_id", "vec_id", F.round(Q.one_bit_ip(), 5).alias("estimate"))


@query("onebit_correlation", f"WITH {E}, {QS}, {CENTER}, {ONE_BIT}, {ESTIMATE} SELECT round(corr(s.d, {l2('qv', 'v')}), 5) AS correlation FROM s JOIN q USING (query_id) JOIN e USING (vec_id)")
def onebit_correlation(spark, d):
    return estimates(spark, d).agg(F.round(F.corr("estimate", "exact"), 5).alias("correlation"))


@query("onebit_rerank", f"""WITH {E}, {QS}, {CENTER}, {ONE_BIT}, {ESTIMATE}, w AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER
(PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS n FROM s) WHERE n <= {K * 5}), t AS (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
FROM (SELECT query_id, vec_id, {l2('qv', 'v')} AS d FROM w JOIN q USING (query_id) JOIN e USING (vec_id))) {shown('t')} WHERE rank <= {K}""")
def onebit_rerank(spark, d):
    return reported(Q.one_bit_search(coded(spark, d), stated(emb(spark, d)), K, 5))


def _multi(name: str, bits: int):
    sql = {
        "coded_search": f"WITH {coded_search_sql(bits, 'w', K)} {shown('w')}",
        "rerank_search": f"WITH {coded_search_sql(bits, 'w', 3 * K)}, {found_sql('f', 'w')} {shown('f')}",
        "reconstruct_error": f"""WITH {E}, {HEADS}, {ASSIGNED}, {POSTINGS}, {codes_sql(bits, CODED_ROWS)}, y AS (SELECT r_square,
list_transform(list_zip(list_zip(c, x), v), lambda y: y[1][1] + scale * y[1][2] - y[2]) AS w FROM z)
SELECT count(*) AS n, round(avg({ip('w', 'w')}), 6) AS mean_square, round(avg(r_square), 6) AS residual FROM y""",
    }

    @query(f"{name}_{bits}bit", sql[name])
    def run(spark, d):
        i = index_of(spark, d, bits=bits)
        i.postings = i.postings.join(Q.multi_bit(gathered(spark, d), bits), ["head_id", "vec_id"])
        e = emb(spark, d)
        if name == "coded_search":
            return reported(i.search_coded(stated(e), K))
        if name == "rerank_search":
            return reported(i.search(stated(e), K))
        centers = i.heads.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("centroid"))
        rows = i.postings.join(centers, "head_id").join(e.select("vec_id", "embedding"), "vec_id")
        away = V.minus(Q.reconstructed(bits), F.col("embedding"))
        return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.dot(away, away)), 6).alias("mean_square"), F.round(F.avg(F.col("r_square").cast("double")), 6).alias("residual"))

    return run


for _bits in (1, 2, 4):
    for _name in ("coded_search", "rerank_search", "reconstruct_error"):
        _multi(_name, _bits)


@query("size_accounting", f"""WITH {E}, {HEADS}, {ASSIGNED}, {POSTINGS}, t AS (SELECT count(*) AS n, CAST(sum(4 * len(v)) AS BIGINT) AS raw, any_value(len(v)) AS dim FROM p JOIN e USING (vec_id))
SELECT bits, n AS n_rows, raw AS raw_bytes, CAST(n * (8 * ceil(dim * bits / 64.0) + 20) AS BIGINT) AS code_bytes, round(raw / (n * (8 * ceil(dim * bits / 64.0) + 20)), 6) AS ratio
FROM t, (VALUES (1), (2), (4)) b(bits)""")
def size_accounting(spark, d):
    """Bytes of the vectors and of the codes as the index holds them."""
    found = None
    for bits in (1, 2, 4):
        rows = gathered(spark, d)
        row = Q.code_bytes(rows.join(Q.multi_bit(rows, bits), ["head_id", "vec_id"])).withColumn("bits", F.lit(bits))
        found = row if found is None else found.unionByName(row)
    return found.withColumn("ratio", F.round(F.col("raw_bytes") / F.col("code_bytes"), 6))


def _quality_sql(bits: int, metric: str) -> str:
    rows = "SELECT 0 AS head_id, vec_id, v, c FROM e, m"
    exact = l2("qv", "v") if metric == "l2" else f"-{ip('qv', 'v')}"
    return f"""{E}, {QS}, {CENTER}, {codes_sql(bits, rows)}, s AS (SELECT query_id, vec_id, {ESTIMATED[metric]} AS d, {exact} AS true_d FROM q, z),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY round(true_d, 9), vec_id) AS b FROM s)
SELECT round(count(*) FILTER (WHERE a <= {K} AND b <= {K}) / (count(*) FILTER (WHERE b <= {K}))::DOUBLE, 6) AS recall, round(corr(d, true_d), 5) AS correlation FROM r"""


@query("quantizer_quality", settings_sql([(f"{b} AS bits, '{m}' AS metric", _quality_sql(b, m)) for b in (1, 2, 4) for m in ("l2", "ip")]))
def quantizer_quality(spark, d):
    """Recall of the estimates' ranking, and their correlation with exact distances, with one centroid for all rows."""
    e = emb(spark, d).select("vec_id", "embedding")
    rows = e.crossJoin(F.broadcast(mean_vectors(e, []))).withColumn("head_id", F.lit(0).cast("bigint"))  # one centroid
    q = stated(e).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    by, found = Window.partitionBy("query_id"), None
    for bits in (1, 2, 4):
        coded_rows = rows.join(Q.multi_bit(rows, bits), ["head_id", "vec_id"])
        for metric in ("l2", "ip"):
            pairs = against(coded_rows, q).withColumn("d", Q.multi_bit_distance(bits, metric)).withColumn("true_d", V.distance(metric, "query_vec", "embedding"))
            placed = pairs.withColumn("a", F.row_number().over(by.orderBy(F.round("d", 9), "vec_id"))).withColumn("b", F.row_number().over(by.orderBy(F.round("true_d", 9), "vec_id")))
            near = F.col("b") <= K
            row = placed.agg(
                F.round(F.count_if(near & (F.col("a") <= K)) / F.count_if(near), 6).alias("recall"), F.round(F.corr("d", "true_d"), 5).alias("correlation")
            ).select(F.lit(bits).alias("bits"), F.lit(metric).alias("metric"), "recall", "correlation")
            found = row if found is None else found.unionByName(row)
    return found


_NEAREST_HEAD = "SELECT head_id, vec_id, v, hv AS c FROM a JOIN h USING (head_id) JOIN e USING (vec_id) WHERE head_rank = 1"


@query("reconstructed_search", f"""WITH {E}, {QS}, {HEADS}, {ASSIGNED}, {codes_sql(4, _NEAREST_HEAD)}, {TRUE},
y AS (SELECT vec_id, list_transform(list_zip(c, x), lambda y: y[1] + scale * y[2]) AS w FROM z),
f AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {l2('qv', 'w')}, vec_id) AS rank FROM q, y) WHERE rank <= {K}) {recall_sql('f')}""")
def reconstructed_search(spark, d):
    """Recall of a search over vectors that were coded by four bits against their nearest head, and made from the codes again."""
    e = emb(spark, d).select("vec_id", "embedding")
    heads = heads_of(e)
    near = nearest_points(e, heads, 1).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("head_id"))
    centers = heads.select(F.col("vec_id").alias("head_id"), F.col("embedding").alias("centroid"))
    rows = near.join(centers, "head_id").join(e, "vec_id")
    made = rows.select("head_id", "vec_id", "centroid").join(Q.multi_bit(rows, 4), ["head_id", "vec_id"])
    made = made.select("vec_id", Q.reconstructed(4).alias("embedding"))
    return mean_recall(knn_join(stated(e), made, K), knn_join(stated(e), e, K), K).select("n_queries", *six("recall"))


_AXES = [(0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0), (4, 0.7, 0.7)]


@query("onebit_steps", f"""WITH e AS (SELECT * FROM (VALUES {", ".join(f"({i}, [{x}, {y}]::DOUBLE[])" for i, x, y in _AXES)}) t(vec_id, v)),
s AS (SELECT vec_id, v, list_transform(v, lambda y: CASE WHEN y > 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS x FROM e), f AS (SELECT *, {ip('v', 'v')} AS n, {ip('v', 'x')} AS p FROM s)
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(n, 6) AS f_add, round(-2 * n / p, 6) AS f_rescale,
round(n + 0.82 + -2 * n / p * {ip('[0.9, 0.1]::DOUBLE[]', 'x')}, 6) AS estimate, round({l2('[0.9, 0.1]::DOUBLE[]', 'v')}, 6) AS exact FROM f""")
def onebit_steps(spark, d):
    """Factors, estimate and exact distance on five rows of two dimensions, from the centroid 0."""
    rows = spark.createDataFrame([(i, [x, y]) for i, x, y in _AXES], "vec_id bigint, embedding array<double>")
    rows = rows.withColumn("centroid", F.array(F.lit(0.0), F.lit(0.0))).withColumn("query_vec", F.array(F.lit(0.9), F.lit(0.1)))
    steps = Q.one_bit(rows).withColumn("estimate", Q.one_bit_l2()).withColumn("exact", V.l2_distance("query_vec", "embedding"))
    return steps.select("vec_id", *six("f_add", "f_rescale", "estimate", "exact"))


# --- graphs and trees -------------------------------------------------------------------------------------------------

EDGES = f"""x AS (SELECT src, dst, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM
  (SELECT a.vec_id AS src, b.vec_id AS dst, {l2('a.v', 'b.v')} AS d FROM e a, e b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 8)"""


def edges_of(spark, d) -> DataFrame:
    return G.exact_graph(emb(spark, d), 8)


@query("knn_graph_exact", f"WITH {E}, {EDGES} SELECT src, dst, round(d, 6) AS dist, CAST(rank AS INT) AS rank FROM x")
def knn_graph_exact(spark, d):
    return edges_of(spark, d).select("src", "dst", *six("dist"), F.col("rank").cast("int").alias("rank"))


@query("nn_of_nn_candidates", f"WITH {E}, {EDGES} SELECT DISTINCT a.src, b.dst FROM x a JOIN x b ON a.dst = b.src WHERE a.src <> b.dst")
def nn_of_nn_candidates(spark, d):
    return G.neighbours_of_neighbours(edges_of(spark, d))


@query("graph_degree_stats", f"WITH {E}, {EDGES}, k AS (SELECT dst, count(*) AS n FROM x GROUP BY dst) SELECT count(*) AS n_nodes, CAST(sum(n) AS BIGINT) AS n_edges, max(n) AS most, round(avg(n), 6) AS mean FROM k")
def graph_degree_stats(spark, d):
    n = edges_of(spark, d).groupBy("dst").count()
    return n.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("count").alias("n_edges"), F.max("count").alias("most"), F.round(F.avg("count"), 6).alias("mean"))


RING = f"""i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM e),
o AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM i a, range(1, 9) s(k) JOIN i b ON b.place = (a.place + k) % a.n)"""


@query("refined_graph", f"""WITH {E}, {RING}, w AS (SELECT src, dst FROM o UNION SELECT a.src, b.dst FROM o a JOIN o b ON a.dst = b.src WHERE a.src <> b.dst),
x AS (SELECT src, dst, {l2('a.v', 'b.v')} AS d FROM w JOIN e a ON a.vec_id = src JOIN e b ON b.vec_id = dst)
SELECT src, dst, round(d, 6) AS dist, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM x) WHERE rank <= 8""")
def refined_graph(spark, d):
    """One round from a poor graph: each row linked to the eight next by id."""
    e = emb(spark, d).select("vec_id", "embedding")
    place = Window.orderBy("vec_id")  # ids alone
    ids = e.select("vec_id").withColumn("place", F.row_number().over(place) - 1)
    n = ids.count()
    steps = ids.select(F.col("vec_id").alias("src"), F.explode(F.expr(f"transform(sequence(1, 8), k -> (place + k) % {n})")).alias("place"))
    ring = steps.join(ids.withColumnRenamed("vec_id", "dst"), "place").select("src", "dst")
    return G.refine(ring, e, 8).select("src", "dst", *six("dist"), F.col("rank").cast("int").alias("rank"))


PRUNED = f"""k AS (SELECT vec_id AS src, 0 AS place, CAST([] AS DOUBLE[][]) AS kept, CAST(NULL AS BIGINT) AS dst, CAST(NULL AS DOUBLE) AS d, FALSE AS stays FROM e UNION ALL
SELECT src, place, CASE WHEN stays THEN list_append(kept, v) ELSE kept END, dst, d, stays FROM (SELECT k.src, k.place + 1 AS place, k.kept, x.dst, x.d, e.v,
coalesce(list_bool_and(list_transform(k.kept, lambda y: {l2('y', 'e.v')} >= x.d)), TRUE) AS stays FROM k JOIN x ON x.src = k.src AND x.rank = k.place + 1 JOIN e ON e.vec_id = x.dst))"""


@query("rng_prune", f"WITH RECURSIVE {E}, {EDGES}, {PRUNED} SELECT src, dst, round(d, 6) AS dist, CAST(row_number() OVER (PARTITION BY src ORDER BY place) AS INT) AS rank FROM k WHERE stays")
def rng_prune(spark, d):
    e = emb(spark, d).select("vec_id", "embedding")
    return G.prune_relative(edges_of(spark, d), e, 8).select("src", "dst", *six("dist"), "rank")


N_QUERIES = "SELECT count(*) AS n_queries, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0"


def reached(found: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """n_queries, and whether the mean recall is at least ``least``."""
    return mean_recall(found, truth, K).select("n_queries", (F.col("recall") >= least).alias("reached"))


@query("index_complete", "SELECT count(*) AS n_indexed FROM embeddings")
def index_complete(spark, d):
    """Rows in some list of an index whose heads were chosen from a sample smaller than the table."""
    e = emb(spark, d)
    return VectorIndex.build(e, IndexConfig(ratio=RATIO, head_sample=200, replicas=4, posting_limit=1)).postings.agg(F.countDistinct("vec_id").alias("n_indexed"))


@query("ip_index_recall", N_QUERIES)
def ip_index_recall(spark, d):
    """Inner products of vectors of unequal norms: nine of ten of the true neighbours are found."""
    e = emb(spark, d)
    uneven = e.select("vec_id", F.transform("embedding", lambda x: (x * (1 + F.col("label"))).cast("float")).alias("embedding"))
    index = VectorIndex.build(uneven, config(metric="ip", probes=12, max_check=1 << 20))
    return reached(index.search(stated(uneven), K), knn_join(stated(uneven), uneven, K, "ip"), 0.9)


@query("head_graph_recall", N_QUERIES)
def head_graph_recall(spark, d):
    """Heads found through their tree and graph, against all heads compared."""
    e = emb(spark, d).select("vec_id", "embedding")
    heads = C.strided(e, 0.5)
    links, nodes = G.head_graph(heads)
    return reached(G.graph_search(stated(e), heads, links, K, entries=4, max_checks=1024, tree=nodes), knn_join(stated(e), heads, K), 0.9)


@query("graph_index_search", N_QUERIES)
def graph_index_search(spark, d):
    """An index that looks for its heads in their graph, stored, loaded and searched."""
    e = emb(spark, d).select("vec_id", "embedding")
    path = scratch(spark, "graph-index")
    VectorIndex.build(e, config(head_search="graph", probes=16, max_check=1 << 20)).save(path)
    return reached(VectorIndex.load(spark, path).search(stated(e), K), knn_join(stated(e), e, K), 0.9)


def _single_level(name: str, **more):
    @query(name, N_QUERIES)
    def run(spark, d):
        """One graph over all rows, searched from a tree's centers or from single entries."""
        e = emb(spark, d).select("vec_id", "embedding")
        links = G.refine(G.tree_seeded(e, 16, leaf=150), e, 16)
        tree = None
        if more.get("tree"):
            ids, x = C.sampled(e, C.SAMPLE_ROWS)
            tree = spark.createDataFrame(C.bk_tree(ids, x, medoids=more.get("medoids", False)).table(), "node_id bigint, parent_id bigint, center_id bigint, is_leaf boolean")
        found = G.graph_search(stated(e), e, links, K, entries=more["entries"], max_checks=more["checks"], beam=more.get("beam"), tree=tree)
        return reached(found, knn_join(stated(e), e, K), 0.9)

    return run


_single_level("tree_entry_search", entries=8, checks=8192, tree=True, beam=64)
_single_level("medoid_entry_search", entries=8, checks=8192, tree=True, medoids=True, beam=64)
_single_level("single_entry_search", entries=1, checks=None, beam=128)


@query("graph_from_index", "SELECT count(*) AS n_nodes, TRUE AS reached FROM embeddings")
def graph_from_index(spark, d):
    """Neighbours that an index's search finds, against the exact graph."""
    e = emb(spark, d).select("vec_id", "embedding")
    index = index_of(spark, d, probes=12, max_check=1 << 20)
    found = G.graph_from_search(e, index.search, 8).select("src", "dst").withColumn("hit", F.lit(1))
    each = edges_of(spark, d).join(found, ["src", "dst"], "left").agg(F.countDistinct("src").alias("n_nodes"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return each.select("n_nodes", (F.col("share") >= 0.9).alias("reached"))


@query("resampled_rows", "SELECT TRUE AS near_n, TRUE AS repeats, 0::BIGINT AS n_strange")
def resampled_rows(spark, d):
    """As many draws with replacement as rows: about that many, some rows more than once, none that is not there."""
    e = emb(spark, d).select("vec_id")
    n = e.count()
    got = C.resampled(e, n)
    strange = got.join(e, "vec_id", "left_anti").count()
    return got.agg(
        (F.abs(F.count(F.lit(1)) - n) <= F.lit(6 * n**0.5)).alias("near_n"), (F.max("draw") > 1).alias("repeats"), F.lit(strange).cast("bigint").alias("n_strange")
    )


@query("lloyd_kmeans")
def lloyd_kmeans(spark, d):
    """Plain k-means to its end on a bounded sample; sizes and objective over all rows."""
    e = emb(spark, d)
    _, x = C.sampled(e, 10_000)
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(C.lloyd(x, 10).centers)], "cluster bigint, center array<double>")
    near = nearest_points(e, centers, 1, point_id="cluster", point_vec="center")
    return near.groupBy(F.col("vec_id").alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("distance"), 6).alias("objective"))


@query("graph_search")
def graph_search(spark, d):
    e = emb(spark, d).select("vec_id", "embedding")
    heads = heads_of(e)
    return reported(G.graph_search(stated(e), heads, G.exact_graph(heads, 16), K))


def _leaves(name: str, make):
    @query(name)
    def run(spark, d):
        e = emb(spark, d)
        tree = make(*C.sampled(e, C.SAMPLE_ROWS))
        return C.memberships(e, tree)

    return run


_leaves("bktree_leaves", lambda ids, x: C.bk_tree(ids, x))
_leaves("kdtree_leaves", lambda ids, x: C.split_tree(x, "kd", 100))
_leaves("tptree_leaves", lambda ids, x: C.split_tree(x, "tp", 200))


@query("tree_graph")
def tree_graph(spark, d):
    """Neighbours within the leaves of four projection trees, the nearest eight kept."""
    return G.tree_seeded(emb(spark, d), 8).select("src", "dst", *six("dist"), F.col("rank").cast("int").alias("rank"))


@query("kdtree_search")
def kdtree_search(spark, d):
    """The nearest rows of the query's own leaf, in each of four trees over random halves of the dimensions."""
    e = emb(spark, d).select("vec_id", "embedding")
    ids, x = C.sampled(e, C.SAMPLE_ROWS)
    q = stated(e).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pairs = None
    for seed in range(4):
        tree = C.split_tree(x, "tp", 120, top=x.shape[1] // 2, tries=4, seed=seed) if seed else C.split_tree(x, "kd", 120)
        leaves = C.memberships(e, tree)
        mine = leaves.join(q, F.col("vec_id") == F.col("query_id")).select("query_id", "query_vec", "node_id")
        met = mine.join(leaves, "node_id").select("query_id", "query_vec", "vec_id")
        pairs = met if pairs is None else pairs.unionByName(met)
    near = pairs.dropDuplicates(["query_id", "vec_id"]).join(e, "vec_id")
    near = near.withColumn("distance", F.round(V.l2_distance("query_vec", "embedding"), 9))
    return reported(ranked(near, K))


@query("pruned_graph")
def pruned_graph(spark, d):
    """Tree-seeded neighbours, refined and pruned twice."""
    e = emb(spark, d).select("vec_id", "embedding")
    return G.refine_and_prune(G.tree_seeded(e, 16), e, 8, 16).select("src", "dst", *six("dist"), "rank")


# --- comparisons of settings: a row per setting ------------------------------------------------------------------------


def _recalls(settings: list[tuple], search, truth: DataFrame, names: list[str]) -> DataFrame:
    found = None
    for values in settings:
        row = mean_recall(search(*values), truth, K).select(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True)), "n_queries", *six("recall"))
        found = row if found is None else found.unionByName(row)
    return found


@query("probe_sweep", settings_sql([(f"{p} AS probes, {c} AS max_check", f"{index_sql(p, c)}, {FOUND}, {TRUE} {recall_sql('f')}") for p in (4, 8, 16) for c in (100, 400)]))
def probe_sweep(spark, d):
    """Recall by heads probed and candidates checked."""
    e = emb(spark, d)
    q, truth = stated(e), knn_join(stated(e), e, K)
    grid = [(p, c) for p in (4, 8, 16) for c in (100, 400)]
    return _recalls(grid, lambda p, c: index_of(spark, d, probes=p, max_check=c).search(q, K), truth, ["probes", "max_check"])


def _coded_index(spark, d, bits: int, **more) -> VectorIndex:
    i = index_of(spark, d, bits=bits, probes=16, **more)
    if bits:
        i.postings = i.postings.join(Q.multi_bit(gathered(spark, d), bits), ["head_id", "vec_id"])
    return i


@query("quantization_compare", settings_sql([("0 AS bits", f"{index_sql(16)}, {FOUND}, {TRUE} {recall_sql('f')}"),
    *((f"{b} AS bits", f"{coded_search_sql(b, 'f', K, 16)}, {TRUE} {recall_sql('f')}") for b in (1, 2, 4))]))
def quantization_compare(spark, d):
    """Recall of the codes' own ranking by bits; 0 is exact distances."""
    e = emb(spark, d)
    q, truth = stated(e), knn_join(stated(e), e, K)

    def search(bits):
        i = _coded_index(spark, d, bits)
        return i.search_coded(q, K) if bits else i.search(q, K)

    return _recalls([(0,), (1,), (2,), (4,)], search, truth, ["bits"])


@query("rerank_sweep", settings_sql([(f"{r} AS rerank", f"{coded_search_sql(1, 'w', r * K, 16)}, {found_sql('f', 'w')}, {TRUE} {recall_sql('f')}") for r in (2, 5, 10)]))
def rerank_sweep(spark, d):
    """Recall of 1-bit codes by how many times k candidates are ranked again."""
    e = emb(spark, d)
    q, truth = stated(e), knn_join(stated(e), e, K)
    return _recalls([(2,), (5,), (10,)], lambda r: _coded_index(spark, d, 1, rerank=r).search(q, K), truth, ["rerank"])


@query("hbc_heads")
def hbc_heads(spark, d):
    return C.select_heads(emb(spark, d), RATIO).select("vec_id")


@query("balanced_kmeans")
def balanced_kmeans(spark, d):
    """Centers from 1000 rows of a bounded sample, sizes over all rows."""
    e = emb(spark, d)
    _, x = C.sampled(e, 10_000)
    model = C.auto_balanced(x[:1000], 10)
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.centers)], "cluster bigint, center array<double>")
    near = nearest_points(e, centers, 1, point_id="cluster", point_vec="center")
    return near.groupBy(F.col("vec_id").alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("distance"), 6).alias("objective"))


# --- what must hold of results that depend on seeded trees -------------------------------------------------------------


@query("tree_partitions", "SELECT kind, count(*) AS n_rows, count(DISTINCT vec_id) AS n_vectors, TRUE AS bounded FROM embeddings, (VALUES ('bk'), ('kd'), ('tp')) k(kind) GROUP BY kind")
def tree_partitions(spark, d):
    """Each row in one leaf of each kind of tree, fitted on few rows; leaves that the table overfills are split on."""
    e, found = emb(spark, d), None
    ids, x = C.sampled(e, 200)
    for kind, tree in (("bk", C.bk_tree(ids, x)), ("kd", C.split_tree(x, "kd", 50)), ("tp", C.split_tree(x, "tp", 50))):
        leaves = C.memberships(e, tree, 60)
        sizes = leaves.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
        row = leaves.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("vec_id").alias("n_vectors")).crossJoin(sizes.agg((F.max("n") <= 120).alias("bounded")))
        row = row.select(F.lit(kind).alias("kind"), "n_rows", "n_vectors", "bounded")
        found = row if found is None else found.unionByName(row)
    return found


@query("head_selection_holds", "SELECT TRUE AS near_ratio, 0::BIGINT AS n_strange")
def head_selection_holds(spark, d):
    e = emb(spark, d).select("vec_id", "embedding")
    heads, n = C.select_heads(e, RATIO).select("vec_id").distinct(), e.count()
    strange = heads.join(e, "vec_id", "left_anti").count()
    return heads.agg((F.abs(F.count(F.lit(1)) - RATIO * n) <= max(2, 0.2 * RATIO * n)).alias("near_ratio"), F.lit(strange).cast("bigint").alias("n_strange"))


@query("index_recall_holds", N_QUERIES)
def index_recall_holds(spark, d):
    return index_recall(spark, d).select("n_queries", (F.col("recall") >= 0.9).alias("reached"))


@query("graph_search_holds", N_QUERIES)
def graph_search_holds(spark, d):
    e = emb(spark, d).select("vec_id", "embedding")
    return reached(graph_search(spark, d), knn_join(stated(e), heads_of(e), K), 0.9)


@query("kdtree_search_holds", N_QUERIES)
def kdtree_search_holds(spark, d):
    """Every query finds itself first."""
    first = kdtree_search(spark, d).where("rank = 1")
    return first.agg(F.count(F.lit(1)).alias("n_queries"), F.bool_and(F.col("query_id") == F.col("vec_id")).alias("reached"))


@query("tree_graph_holds", "SELECT count(*) AS n_nodes, 0::BIGINT AS n_wrong, TRUE AS reached FROM embeddings")
def tree_graph_holds(spark, d):
    """True distances, no loops, and four of ten of the true neighbours from four trees' leaves alone."""
    e = emb(spark, d).select("vec_id", "embedding")
    edges = G.tree_seeded(e, 8)
    a, b = (e.select(F.col("vec_id").alias(c), F.col("embedding").alias(f"v_{c}")) for c in ("src", "dst"))
    right = (F.abs(V.l2_distance("v_src", "v_dst") - F.col("dist")) < 1e-6) & (F.col("src") != F.col("dst"))
    checked = edges.join(a, "src").join(b, "dst").agg(F.countDistinct("src").alias("n_nodes"), F.count_if(~right).alias("n_wrong"))
    true = edges_of(spark, d).select("src", "dst").join(edges.select("src", "dst").withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    return checked.crossJoin(true.agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.4).alias("reached")))


@query("pruned_graph_holds", "SELECT count(*) AS n_nodes, 0::BIGINT AS n_against, TRUE AS bounded FROM embeddings")
def pruned_graph_holds(spark, d):
    """No edge whose end is nearer to an earlier neighbour of the same node; eight a node at most."""
    e = emb(spark, d).select("vec_id", "embedding")
    edges = pruned_graph(spark, d).select("src", "dst", "dist", "rank")
    ends = e.select(F.col("vec_id").alias("dst"), "embedding")
    later = edges.join(ends, "dst").withColumnRenamed("embedding", "x")
    earlier = edges.join(ends, "dst").select("src", F.col("rank").alias("before"), F.col("embedding").alias("y"))
    against = later.join(earlier, "src").where("before < rank").where(V.l2_distance("x", "y") < F.col("dist") - 1e-5).count()
    return edges.agg(F.countDistinct("src").alias("n_nodes"), F.lit(against).cast("bigint").alias("n_against"), (F.max("rank") <= 8).alias("bounded"))


@query("kmeans_holds", "SELECT kind, CAST(count(*) AS BIGINT) AS n_rows, TRUE AS even FROM embeddings, (VALUES ('balanced'), ('lloyd')) k(kind) GROUP BY kind")
def kmeans_holds(spark, d):
    """All rows have a cluster; the balanced clustering of the sample is at least as even as one without penalty."""
    _, x = C.sampled(emb(spark, d), 10_000)
    even = C.balance(C.auto_balanced(x[:1000], 10).counts) <= C.balance(C.balanced_kmeans(x[:1000], 10).counts)
    rows = balanced_kmeans(spark, d).agg(F.sum("size").alias("n_rows")).select(F.lit("balanced").alias("kind"), "n_rows", F.lit(bool(even)).alias("even"))
    plain = lloyd_kmeans(spark, d).agg(F.sum("size").alias("n_rows")).select(F.lit("lloyd").alias("kind"), "n_rows", F.lit(True).alias("even"))
    return rows.unionByName(plain)


@query("latency_percentiles", """SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean,
quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    found = percentiles(spark.read.parquet(f"{d}/events.parquet"), "value", ["event_type"])
    return found.withColumn("mean", F.round("mean", 6))


@query("stored_index_search")
def stored_index_search(spark, d):
    """Built, saved, loaded and searched; the same rows as ivf_search."""
    path = scratch(spark, "index")
    index_of(spark, d).save(path)
    return reported(VectorIndex.load(spark, path).search(stated(emb(spark, d)), K))


_sql["stored_index_search"] = _sql["ivf_search"]


@query("list_search", f"WITH {index_sql(PROBES, 1 << 20)}, {FOUND} {shown('f')}")
def list_search(spark, d):
    """The probed lists read in place, with vectors beside the postings."""
    i = index_of(spark, d, inline=True, max_check=1 << 20)
    i.postings = i.postings.join(i.vectors, "vec_id")
    return reported(i.search(stated(emb(spark, d)), K))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

"""Queries on graphs: sources, transforms, statistics, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..coins import SIDES, u32_sql
from ..operators import fixpoint, immunize, statistics, transforms
from ..runtime import cut
from ..sources.derived import PART_SQL, SUPP_SQL, TRADE_SQL, USER_SQL, part, supp, trade, user
from .registry import query

WITH_TRADE, WITH_SUPP, WITH_PART, WITH_USER = (f"WITH RECURSIVE e AS ({sql})" for sql in (TRADE_SQL, SUPP_SQL, PART_SQL, USER_SQL))
NODES = "SELECT src AS id FROM e UNION SELECT dst FROM e"


@query(TRADE_SQL)
def edges_trade(spark, sf_dir):
    return trade(spark, sf_dir)


@query(SUPP_SQL)
def edges_supp(spark, sf_dir):
    return supp(spark, sf_dir)


@query(PART_SQL)
def edges_part(spark, sf_dir):
    return part(spark, sf_dir)


@query(USER_SQL)
def edges_user(spark, sf_dir):
    return user(spark, sf_dir)


@query(f"{WITH_USER} SELECT src, dst, CAST(min(c) AS BIGINT) AS c FROM (SELECT src, dst, c FROM e UNION ALL SELECT dst, src, c FROM e) GROUP BY 1, 2")
def both_directions(spark, sf_dir):
    return transforms.both_directions(user(spark, sf_dir))


@query(f"{WITH_PART} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e")
def undirected_view(spark, sf_dir):
    return transforms.undirected(part(spark, sf_dir))


@query(
    f"""{WITH_USER}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
    f AS (SELECT a, b, {u32_sql("direction", "a", "b")} >= {1 << 31} AS flip FROM p)
    SELECT CASE WHEN flip THEN b ELSE a END AS src, CASE WHEN flip THEN a ELSE b END AS dst FROM f"""
)
def random_direction(spark, sf_dir):
    return transforms.random_direction(user(spark, sf_dir))


@query(
    f"""{WITH_PART}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM ({NODES}))
    SELECT a.n AS src, b.n AS dst, c FROM e JOIN ids a ON src = a.id JOIN ids b ON dst = b.id"""
)
def relabel_dense(spark, sf_dir):
    return transforms.relabel(part(spark, sf_dir))


@query(f"{WITH_SUPP} SELECT src, dst, c FROM e WHERE src % 7 <> 3 AND dst % 7 <> 3")
def block_nodes(spark, sf_dir):
    edges = supp(spark, sf_dir)
    return transforms.block(edges, transforms.nodes(edges).filter("id % 7 = 3").withColumnRenamed("id", "node"))


@query(f"{WITH_SUPP} SELECT src, dst, CASE WHEN src % 2 = 0 THEN 0.5 ELSE round(c / 300.0, 6) END AS weight FROM e WHERE (src + dst) % 3 = 0 AND src % 7 <> 3 AND dst % 7 <> 3")
def scan_with_edgelist(spark, sf_dir):
    edges = supp(spark, sf_dir).withColumn("weight", F.round(F.col("c") / 300.0, 6))
    blocked = transforms.nodes(edges).filter("id % 7 = 3").withColumnRenamed("id", "node")
    listed = edges.filter("(src + dst) % 3 = 0").select("src", "dst", F.when(F.col("src") % 2 == 0, 0.5).alias("weight"))
    return transforms.replace_edges(edges.select("src", "dst", "weight"), listed, blocked)


@query(f"{WITH_PART} SELECT dst, src, round(c / CAST(sum(c) OVER (PARTITION BY dst) AS DOUBLE), 6) AS weight FROM e")
def in_weight_normalised(spark, sf_dir):
    w = transforms.normalise_in_weights(part(spark, sf_dir).withColumn("weight", F.col("c").cast("double")))
    return w.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"{WITH_PART} SELECT dst, src, round(1.0 / count(*) OVER (PARTITION BY dst), 6) AS weight FROM e")
def in_degree_normalised(spark, sf_dir):
    w = transforms.normalise_in_weights(part(spark, sf_dir).withColumn("weight", F.lit(1.0)), by="degree")
    return w.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"{WITH_SUPP} SELECT src, dst, round({u32_sql('weight', 'src', 'dst')} / {SIDES}.0 * 0.3, 6) AS weight FROM e")
def random_weights(spark, sf_dir):
    w = transforms.assign_weights(supp(spark, sf_dir), 0.3, random=True)
    return w.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"{WITH_SUPP} SELECT src, dst, round(CASE WHEN 2 * (c / 12.0) > 1 THEN 0.99 ELSE 2 * (c / 12.0) END, 6) AS weight FROM e")
def perturbed_weights(spark, sf_dir):
    w = transforms.double_weights(supp(spark, sf_dir).withColumn("weight", F.col("c") / 12.0))
    return w.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"{WITH_SUPP} SELECT src, dst, round(-ln(CASE WHEN c / 12.0 >= 1 THEN 0.99999 ELSE c / 12.0 END), 6) AS distance FROM e")
def log_distances(spark, sf_dir):
    w = transforms.log_distance(supp(spark, sf_dir).withColumn("weight", F.col("c") / 12.0))
    return w.select("src", "dst", F.round("distance", 6).alias("distance"))


@query(
    f"""{WITH_SUPP} SELECT dst, round(CASE WHEN max(c) >= 12 THEN 1.0 ELSE 1 - exp(sum(CASE WHEN c < 12 THEN ln(1 - c / 12.0) END)) END, 6) AS weight
    FROM e GROUP BY dst"""
)
def noisy_or_merge(spark, sf_dir):
    w = transforms.noisy_or(supp(spark, sf_dir).withColumn("weight", F.col("c") / 12.0), ["dst"])
    return w.select("dst", F.round("weight", 6).alias("weight"))


@query(
    f"""{WITH_PART}, m AS (SELECT src AS ego, dst AS node FROM e UNION SELECT src, src FROM e),
    n AS (SELECT ego, count(*) AS n FROM m GROUP BY ego HAVING count(*) BETWEEN 10 AND 50)
    SELECT n.ego, n.n, count(*) AS m FROM n JOIN m x ON x.ego = n.ego JOIN e ON e.src = x.node JOIN m y ON y.ego = n.ego AND y.node = e.dst
    GROUP BY n.ego, n.n HAVING count(*) BETWEEN 10 AND 300"""
)
def ego_networks(spark, sf_dir):
    return transforms.ego_networks(part(spark, sf_dir))


DEGREES = "d AS (SELECT node, sum(i) AS i, sum(o) AS o, sum(i + o) AS g FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)"


@query(
    f"""{WITH_PART}, {DEGREES} SELECT count(*) AS n, (SELECT count(*) FROM e) AS m, CAST(min(g) AS BIGINT) AS min_degree, CAST(max(g) AS BIGINT) AS max_degree,
    round(avg(g), 6) AS avg_degree, round(stddev_pop(g), 6) AS std_degree, CAST(median(g) AS DOUBLE) AS median_degree FROM d"""
)
def degree_stats(spark, sf_dir):
    return statistics.degree_stats(part(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_degree", "std_degree")})


@query(f"{WITH_PART}, {DEGREES} SELECT round(corr(a.o, b.i), 6) AS assortativity FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst")
def assortativity(spark, sf_dir):
    return statistics.assortativity(part(spark, sf_dir)).select(F.round("assortativity", 6).alias("assortativity"))


@query(
    f"""{WITH_PART}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
    n AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p), g AS (SELECT u, count(*) AS g FROM n GROUP BY u),
    t AS (SELECT x.u, count(*) AS t FROM n x JOIN n y ON x.u = y.u AND x.v < y.v JOIN p ON p.a = x.v AND p.b = y.v GROUP BY x.u)
    SELECT round(avg(CASE WHEN g > 1 THEN 2.0 * coalesce(t, 0) / (g * (g - 1)) ELSE 0 END), 6) AS average_clustering FROM g LEFT JOIN t USING (u)"""
)
def avg_clustering(spark, sf_dir):
    return statistics.average_clustering(part(spark, sf_dir)).select(F.round("average_clustering", 6).alias("average_clustering"))


@query(
    f"""{WITH_SUPP}, s AS (SELECT src, dst FROM e),
    r(u, v) AS (SELECT src, dst FROM s UNION SELECT u, dst FROM r JOIN s ON v = src),
    n AS (SELECT src AS u FROM s UNION SELECT dst FROM s),
    k AS (SELECT n.u, least(n.u, min(x.v)) AS scc FROM n LEFT JOIN (SELECT a.u, a.v FROM r a JOIN r b ON a.u = b.v AND a.v = b.u) x ON x.u = n.u GROUP BY n.u)
    SELECT coalesce(scc, u) AS scc, count(*) AS size FROM k GROUP BY 1"""
)
def scc_sizes(spark, sf_dir):
    edges = cut(supp(spark, sf_dir).select("src", "dst"))
    return fixpoint.strong_components(edges, transforms.nodes(edges)).groupBy("scc").agg(F.count(F.lit(1)).alias("size"))


@query(
    f"""{WITH_SUPP}, s AS (SELECT src, dst FROM e),
    b AS (SELECT src AS u, dst AS v FROM s UNION SELECT dst, src FROM s),
    r(u, v) AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u)
    SELECT component, count(*) AS size FROM (SELECT u, least(u, min(v)) AS component FROM r GROUP BY u) GROUP BY 1"""
)
def weak_component_sizes(spark, sf_dir):
    return fixpoint.weak_components(cut(supp(spark, sf_dir).select("src", "dst"))).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(
    f"""{WITH_PART}, r(node, depth) AS (SELECT 1, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 12)
    SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node"""
)
def bfs_levels(spark, sf_dir):
    edges = part(spark, sf_dir)
    return fixpoint.reach(spark.range(1, 2).withColumnRenamed("id", "node"), edges, [])


@query(
    f"""{WITH_USER}, q AS (SELECT DISTINCT user_id AS u FROM events), r(u, v) AS (SELECT u, u FROM q UNION SELECT u, dst FROM r JOIN e ON v = src)
    SELECT u AS src, v AS dst FROM r JOIN q USING (u) WHERE u <> v"""
)
def reach_pairs(spark, sf_dir):
    """The reachable pairs of users; what is not reachable gives no row."""
    from ..sources.derived import table

    closure = fixpoint.reach_pairs(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), cut(user(spark, sf_dir)))
    return closure.filter("s <> node").select(F.col("s").alias("src"), F.col("node").alias("dst"))


@query(
    f"""{WITH_TRADE}, w AS (SELECT src, dst, 1 + c % 17 AS d FROM e), r(node, dist) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, dist + d FROM r JOIN w ON src = node WHERE dist + d <= 40)
    SELECT node, CAST(min(dist) AS DOUBLE) AS distance FROM r GROUP BY node"""
)
def shortest_distances(spark, sf_dir):
    edges = trade(spark, sf_dir).select("src", "dst", (1 + F.col("c") % 17).cast("double").alias("distance"))
    return fixpoint.shortest(spark.range(1).withColumnRenamed("id", "node"), edges, [], limit=40.5)


@query(f"{WITH_PART}, {DEGREES} SELECT row_number() OVER (ORDER BY g DESC, node DESC) - 1 AS rank, node, CAST(g AS BIGINT) AS score FROM d")
def immunize_degree(spark, sf_dir):
    return immunize.degree(part(spark, sf_dir))


@query(f"{WITH_PART} SELECT row_number() OVER (ORDER BY {u32_sql('random', 'id')}, id) - 1 AS rank, id AS node FROM ({NODES})")
def immunize_random(spark, sf_dir):
    edges = part(spark, sf_dir)
    return immunize.ranked(transforms.nodes(edges).select(F.col("id").alias("node"), (-immunize.u32("random", "id")).alias("score"))).select("rank", "node")


def _weighted(edges):
    return edges.select("src", "dst", F.col("c").cast("double").alias("weight"))


@query(
    f"""{WITH_SUPP}, n AS ({NODES}), k AS (SELECT count(*) AS k FROM n), o AS (SELECT src, sum(c) AS t FROM e GROUP BY src),
    s AS (SELECT e.src, e.dst, e.c / CAST(o.t AS DOUBLE) AS share FROM e JOIN o ON o.src = e.src),
    r AS (SELECT 0 AS i, id, 1.0 / k AS x FROM n, k UNION ALL SELECT min(i) + 1, id, min(0.85 * coalesce(got, 0) + 0.85 * lost / k + 0.15 / k)
      FROM (SELECT n.id, (SELECT min(i) FROM r) AS i, k.k, (SELECT sum(s.share * r.x) FROM s JOIN r ON r.id = s.src WHERE s.dst = n.id) AS got,
        (SELECT coalesce(sum(r.x), 0) FROM r WHERE r.id NOT IN (SELECT src FROM o)) AS lost FROM n, k) WHERE i < 10 GROUP BY id)
    SELECT id AS node, round(x, 6) AS score FROM r WHERE i = 10"""
)
def immunize_pagerank(spark, sf_dir):
    scores = immunize.pagerank(_weighted(supp(spark, sf_dir)), rounds=10)
    return scores.select("node", F.round("score", 6).alias("score"))


@query(
    f"""{WITH_SUPP}, n AS ({NODES}),
    r AS (SELECT 0 AS i, id, CAST(0 AS DOUBLE) AS x FROM n UNION ALL SELECT min(i) + 1, id, min(0.001 * coalesce(got, 0) + 1)
      FROM (SELECT n.id, (SELECT min(i) FROM r) AS i, (SELECT sum(e.c * r.x) FROM e JOIN r ON r.id = e.src WHERE e.dst = n.id) AS got FROM n) WHERE i < 10 GROUP BY id),
    q AS (SELECT id, x FROM r WHERE i = 10)
    SELECT id AS node, round(x / (SELECT sqrt(sum(x * x)) FROM q), 6) AS score FROM q"""
)
def immunize_katz(spark, sf_dir):
    scores = immunize.katz(_weighted(supp(spark, sf_dir)), alpha=0.001, rounds=10)
    return scores.select("node", F.round("score", 6).alias("score"))


@query()
def immunize_netshield(spark, sf_dir):
    return immunize.netshield(_weighted(trade(spark, sf_dir)), 10)


@query()
def immunize_acquaintance(spark, sf_dir):
    return immunize.acquaintance(trade(spark, sf_dir))


@query()
def immunize_betweenness(spark, sf_dir):
    return immunize.ranked(immunize.betweenness(_weighted(supp(spark, sf_dir))))


@query()
def immunize_dava(spark, sf_dir):
    edges = supp(spark, sf_dir).select("src", "dst", (F.col("c") / 300.0).alias("weight"))
    infected = transforms.nodes(edges).filter("id % 10 = 0").withColumnRenamed("id", "node")
    return immunize.dava(edges, infected, 10)


@query(f"{WITH_SUPP} SELECT row_number() OVER (ORDER BY {u32_sql('randpert', 'id')}, id) - 1 AS rank, id AS node FROM ({NODES}) QUALIFY rank < 10")
def immunize_randpert(spark, sf_dir):
    return immunize.random_perturbation(supp(spark, sf_dir), 10).select("rank", "node")

"""Queries on possible worlds, sketches, seeds and resilience over removal orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..coins import happens_sql, u32_sql
from ..operators import fixpoint, immunize, kernels, robust, seeding, sketches, transforms, worlds
from ..runtime import cut
from ..sources.derived import SUPP_DEN, SUPP_SQL, TRADE_DEN, TRADE_SQL, supp, trade
from . import analytics  # noqa: F401  (its SQL is reused)
from .registry import ORACLES, query

WORLDS, SIM_WORLDS, SKETCHES = 20, 10, 200
#: A sparser activation probability for the supplier graph, so that worlds differ.
SUPP_SPARSE = 20 * SUPP_DEN

TRADE = f"e AS ({TRADE_SQL})"
SUPP = f"e AS ({SUPP_SQL})"
DEG = "o AS (SELECT node, row_number() OVER (ORDER BY count(*) DESC, node DESC) - 1 AS rank FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)"
N = "n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def live_sql(den: int, n: int, tag: str = "ic", name: str = "world") -> str:
    return f"live AS (SELECT {name}, src, dst FROM e, (SELECT CAST(range AS INTEGER) AS {name} FROM range({n})) WHERE {happens_sql(u32_sql(tag, 'src', 'dst', name), 'c', den)})"


def lt_sql(den: int, n: int, tag: str = "lt", name: str = "world") -> str:
    return f"""b AS (SELECT src, dst, sum(c) OVER (PARTITION BY dst ORDER BY src) - c AS lo, sum(c) OVER (PARTITION BY dst ORDER BY src) AS hi, greatest(sum(c) OVER (PARTITION BY dst), {den}) AS den FROM e),
    live AS (SELECT {name}, src, dst FROM b, (SELECT CAST(range AS INTEGER) AS {name} FROM range({n}))
      WHERE {u32_sql(tag, 'dst', name)} * den >= lo * 4294967296 AND {u32_sql(tag, 'dst', name)} * den < hi * 4294967296)"""


def closure_sql(den: int, n: int) -> str:
    """reach(w, l, s, v) on the trade graph: v is reachable from s when the first l nodes are gone."""
    return f"""WITH RECURSIVE {TRADE}, {DEG}, {live_sql(den, n)},
    k AS (SELECT world, src, dst, least(a.rank, b.rank) AS r FROM live JOIN o a ON a.node = src JOIN o b ON b.node = dst),
    lv AS (SELECT range AS l FROM range((SELECT count(*) FROM o))),
    reach(w, l, s, v) AS (SELECT w.range, l, node, node FROM range({n}) w, lv JOIN o ON o.rank >= l UNION SELECT w, l, s, dst FROM reach JOIN k ON k.world = w AND k.src = v AND k.r >= l)"""


def _order(edges):
    return immunize.degree(edges).select("node", F.col("rank").cast("int").alias("rank"))


@query(
    f"""{closure_sql(TRADE_DEN, WORLDS)}, c AS (SELECT w, l, s, count(*) AS k FROM reach GROUP BY ALL), m AS (SELECT w, l, max(k) AS k FROM c GROUP BY ALL)
    SELECT CAST(l AS INTEGER) AS l, CAST(sum(k) AS BIGINT) AS sum_max_reach, sum(k) / {WORLDS}.0 AS avg_max_reach FROM m GROUP BY l"""
)
def robust_sequence_trade(spark, sf_dir):
    """Expected largest reach of one node, for every number of removed nodes, by the grouped kernel."""
    edges = trade(spark, sf_dir)
    reach = kernels.max_reach(worlds.live_ic(edges, TRADE_DEN, WORLDS), _order(edges), WORLDS)
    return reach.groupBy("l").agg(F.sum("max_reach").alias("sum_max_reach"), (F.sum("max_reach") / F.lit(float(WORLDS))).alias("avg_max_reach"))


@query(
    f"""{closure_sql(TRADE_DEN, 3)}, c AS (SELECT w, l, s, count(*) AS k FROM reach GROUP BY ALL), m AS (SELECT w, l, max(k) AS k FROM c GROUP BY ALL)
    SELECT CAST(l AS INTEGER) AS l, CAST(sum(k) AS BIGINT) AS sum_max_reach, sum(k) / 3.0 AS avg_max_reach FROM m GROUP BY l"""
)
def robust_sequence_relational(spark, sf_dir):
    """The same by the relational max-min closure, which also takes worlds that fit no task."""
    edges = trade(spark, sf_dir)
    closure = robust.closure(worlds.live_ic(edges, TRADE_DEN, 3), _order(edges), 3)
    return robust.sequence(closure, transforms.nodes(edges).count(), 3)


@query(
    f"""{closure_sql(TRADE_DEN, 5)}, f AS (SELECT a.w, a.l, a.s, min(a.v) AS least FROM reach a JOIN reach b ON a.w = b.w AND a.l = b.l AND a.s = b.v AND a.v = b.s GROUP BY ALL)
    SELECT CAST(w AS INTEGER) AS world, CAST(l AS INTEGER) AS l, count(DISTINCT least) AS n_scc FROM f GROUP BY ALL"""
)
def scc_count_by_level(spark, sf_dir):
    edges = trade(spark, sf_dir)
    return kernels.scc_by_level(worlds.live_ic(edges, TRADE_DEN, 5), _order(edges), 5)


@query(f"{closure_sql(TRADE_DEN, 5)} SELECT CAST(w AS INTEGER) AS world, s, v, CAST(max(l) AS INTEGER) AS b FROM reach GROUP BY ALL")
def bottleneck_pairs(spark, sf_dir):
    edges = trade(spark, sf_dir)
    return robust.closure(worlds.live_ic(edges, TRADE_DEN, 5), _order(edges), 5)


@query()
def greedy_reach_by_level(spark, sf_dir):
    """Nodes that two greedy roots reach, at geometrically sampled levels."""
    edges = trade(spark, sf_dir)
    n = transforms.nodes(edges).count()
    found = kernels.greedy_reach(worlds.live_ic(edges, TRADE_DEN, WORLDS), _order(edges), WORLDS, 2, seeding.levels(1.5, n))
    return found.groupBy("l").agg(F.avg("reach").alias("avg_reach"), F.stddev_pop("reach").alias("std_reach"))


@query("SELECT CAST(unnest([0, 1, 3, 6, 11, 18]) AS INTEGER) AS l")
def level_sample(spark, sf_dir):
    n = transforms.nodes(trade(spark, sf_dir)).count()
    return spark.createDataFrame([(v,) for v in seeding.levels(1.5, n)], "l int")


SEEDS = (1, 7, 13)
_S = ", ".join(f"({v})" for v in SEEDS)


def spread_sql(live: str, n: int) -> str:
    return f"""WITH RECURSIVE {SUPP}, {live}, s AS (SELECT CAST(col0 AS BIGINT) AS node FROM (VALUES {_S})),
    r(w, v) AS (SELECT range, node FROM range({n}), s UNION SELECT w, dst FROM r JOIN live ON world = w AND src = v),
    k AS (SELECT w, count(*) AS k FROM r GROUP BY w)
    SELECT round(sum(k) / {n}.0, 6) AS mean, round(sqrt(greatest(0, sum(k * k) / {n}.0 - (sum(k) / {n}.0) * (sum(k) / {n}.0))), 6) AS std FROM k"""


def _seeds(spark):
    return spark.createDataFrame([(v,) for v in SEEDS], "node long")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(spread_sql(live_sql(SUPP_SPARSE, SIM_WORLDS), SIM_WORLDS))
def ic_spread(spark, sf_dir):
    active = worlds.simulate(worlds.live_ic(supp(spark, sf_dir), SUPP_SPARSE, SIM_WORLDS), _seeds(spark), SIM_WORLDS)
    return _rounded(worlds.spread(active, [], SIM_WORLDS), "mean", "std")


@query(spread_sql(lt_sql(1, SIM_WORLDS), SIM_WORLDS))
def lt_spread(spark, sf_dir):
    """In-weights sum to far more than the denominator here, so every node picks one in-edge."""
    active = worlds.simulate(worlds.live_lt(supp(spark, sf_dir), 1, SIM_WORLDS), _seeds(spark), SIM_WORLDS)
    return _rounded(worlds.spread(active, [], SIM_WORLDS), "mean", "std")


@query(f"WITH {SUPP}, {lt_sql(3000, SIM_WORLDS)} SELECT world, src, dst FROM live")
def lt_live_edges(spark, sf_dir):
    return worlds.live_lt(supp(spark, sf_dir), 3000, SIM_WORLDS)


@query(f"WITH {TRADE}, {live_sql(TRADE_DEN, WORLDS)} SELECT world, count(*) AS live_edges FROM live GROUP BY world")
def ic_live_edges(spark, sf_dir):
    return worlds.live_ic(trade(spark, sf_dir), TRADE_DEN, WORLDS).groupBy("world").agg(F.count(F.lit(1)).alias("live_edges"))


BLOCKED_SQL = f"""bl AS (SELECT 'Degree' AS strategy, node FROM o WHERE rank < 15 UNION ALL SELECT 'None', -1
    UNION ALL SELECT 'Random', id FROM (SELECT id, row_number() OVER (ORDER BY {u32_sql('random', 'id')}, id) - 1 AS rank FROM n) WHERE rank < 15)"""


def _blocked(edges):
    spark = edges.sparkSession
    one = immunize.degree(edges).filter("rank < 15").select(F.lit("Degree").alias("strategy"), "node")
    two = immunize.random_order(edges).filter("rank < 15").select(F.lit("Random").alias("strategy"), "node")
    return one.union(two).union(spark.createDataFrame([("None", -1)], "strategy string, node long"))


@query(
    f"""WITH RECURSIVE {SUPP}, {DEG}, {N}, {live_sql(SUPP_SPARSE, SIM_WORLDS)}, {BLOCKED_SQL}, s AS (SELECT CAST(col0 AS BIGINT) AS node FROM (VALUES {_S})),
    t AS (SELECT DISTINCT strategy FROM bl),
    r(strategy, w, v) AS (SELECT strategy, range, node FROM t, range({SIM_WORLDS}), s WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.strategy = t.strategy AND bl.node = s.node)
      UNION SELECT r.strategy, w, dst FROM r JOIN live ON world = w AND src = v WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.strategy = r.strategy AND bl.node = dst)),
    a AS (SELECT strategy, range AS w, (SELECT count(*) FROM r WHERE r.strategy = t.strategy AND r.w = range) AS k FROM t, range({SIM_WORLDS}))
    SELECT a.strategy, round(avg(a.k), 6) AS activated, round(var_samp(a.k), 6) AS var_activated, round(avg(z.k - a.k), 6) AS saved, round(avg((z.k - a.k) / CAST(z.k AS DOUBLE)), 6) AS fraction_saved
    FROM a JOIN a z ON z.strategy = 'None' AND z.w = a.w GROUP BY a.strategy"""
)
def saved_nodes_by_strategy(spark, sf_dir):
    """Blocked sets compared inside the same realised worlds."""
    edges = supp(spark, sf_dir)
    found = robust.saved_nodes(worlds.live_ic(edges, SUPP_SPARSE, SIM_WORLDS), _seeds(spark), _blocked(edges), SIM_WORLDS, "None")
    return _rounded(found, "activated", "var_activated", "saved", "fraction_saved")


@query(
    f"""WITH {SUPP}, {DEG}, {N}, {BLOCKED_SQL}, s AS (SELECT rank AS pos, node FROM o WHERE rank BETWEEN 10 AND 29),
    k AS (SELECT strategy, pos, node, row_number() OVER (PARTITION BY strategy ORDER BY pos) AS r FROM s, (SELECT DISTINCT strategy FROM bl) t WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.strategy = t.strategy AND bl.node = s.node))
    SELECT strategy, pos, node FROM k WHERE r <= 5"""
)
def replaced_seeds(spark, sf_dir):
    edges = supp(spark, sf_dir)
    seeds = immunize.degree(edges).filter("rank BETWEEN 10 AND 29").select(F.col("rank").alias("pos"), "node")
    return worlds.replaced_seeds(seeds, _blocked(edges), 5)


def rr_sql(live: str) -> str:
    return f"""WITH RECURSIVE {SUPP}, {N}, {live}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n),
    z AS (SELECT CAST(range AS INTEGER) AS rr_id, CAST(floor({u32_sql('root', 'range')} * (SELECT count(*) FROM n) / 4294967296.0) AS BIGINT) AS k FROM range({SKETCHES})),
    r(rr_id, node) AS (SELECT rr_id, id FROM z JOIN i USING (k) UNION SELECT r.rr_id, src FROM r JOIN live ON live.rr_id = r.rr_id AND dst = node)"""


RR_SQL = rr_sql(live_sql(SUPP_SPARSE, SKETCHES, "rric", "rr_id"))


def _rr(spark, sf_dir, model="ic", den=SUPP_SPARSE):
    edges = supp(spark, sf_dir)
    return sketches.rr_sets(edges, transforms.nodes(edges), den, SKETCHES, model).select("rr_id", "node"), transforms.nodes(edges).count()


@query(f"{RR_SQL} SELECT node, count(*) AS covered, count(*) * (SELECT count(*) FROM n) / {SKETCHES}.0 AS influence FROM r GROUP BY node")
def rr_influence(spark, sf_dir):
    rr, n = _rr(spark, sf_dir)
    return sketches.influence(rr, n, SKETCHES)


@query(f"{rr_sql(lt_sql(1, SKETCHES, 'rrlt', 'rr_id'))} SELECT node, count(*) AS covered FROM r GROUP BY node")
def rr_influence_lt(spark, sf_dir):
    rr, n = _rr(spark, sf_dir, "lt", 1)
    return sketches.influence(rr, n, SKETCHES).select("node", "covered")


@query(f"{RR_SQL} SELECT count(DISTINCT rr_id) AS covered, count(DISTINCT rr_id) * (SELECT count(*) FROM n) / {SKETCHES}.0 AS influence FROM r WHERE node IN ({', '.join(map(str, SEEDS))})")
def rr_set_influence(spark, sf_dir):
    rr, n = _rr(spark, sf_dir)
    return sketches.set_influence(rr, _seeds(spark), n, SKETCHES)


@query(f"{rr_sql(live_sql(SUPP_DEN, SKETCHES, 'rric', 'rr_id'))} SELECT CAST(sum(1 + rr_id % 5) AS DOUBLE) AS reward FROM (SELECT DISTINCT rr_id FROM r WHERE node IN ({', '.join(map(str, SEEDS))}))")
def rr_weighted_reward(spark, sf_dir):
    """With the graph's own activation probability: at SUPP_SPARSE hardly a sketch goes beyond its root."""
    rr = _rr(spark, sf_dir, den=SUPP_DEN)[0]
    rewards = spark.range(SKETCHES).select(F.col("id").cast("int").alias("rr_id"), (1 + F.col("id") % 5).cast("double").alias("reward"))
    return sketches.covered_reward(rr, _seeds(spark), rewards)


def greedy_sql(k: int) -> str:
    """k rounds as a chain of common table expressions."""
    parts, before = [], "SELECT -1 AS rr_id WHERE false"
    for i in range(k):
        parts.append(f"b{i} AS (SELECT {i} AS pos, node, count(*) AS gain FROM r WHERE rr_id NOT IN ({before}) GROUP BY node ORDER BY gain DESC, node DESC LIMIT 1), c{i} AS MATERIALIZED (SELECT rr_id FROM r JOIN b{i} USING (node) UNION {before})")
        before = f"SELECT rr_id FROM c{i}"
    return f"{RR_SQL}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT pos, node, gain FROM b{i}" for i in range(k))


@query(greedy_sql(5))
def greedy_seeds_k5(spark, sf_dir):
    rr, _ = _rr(spark, sf_dir)
    return spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(seeding.greedy_cover(rr, 5))], "pos int, node long, gain long")


@query(f"SELECT pos, round(gain * 1.0 / lag(gain) OVER (ORDER BY pos), 6) AS ratio FROM ({greedy_sql(3)})")
def marginal_gain_ratio(spark, sf_dir):
    rr, _ = _rr(spark, sf_dir)
    gains = [g for _, g in seeding.greedy_cover(rr, 3)]
    return spark.createDataFrame([(i, round(g / gains[i - 1], 6) if i else None) for i, g in enumerate(gains)], "pos int, ratio double")


@query()
def imm_seeds(spark, sf_dir):
    """Influence maximisation with its sample size from the published bounds."""
    edges = cut(supp(spark, sf_dir))
    ids = cut(transforms.nodes(edges))
    sampler = sketches.Sampler(edges, ids, SUPP_SPARSE)
    picked, r = seeding.imm(lambda first, r: sampler.sample(first, r).select("rr_id", "node"), ids.count(), 2, 0.5)
    return spark.createDataFrame([(i, v, int(g), r) for i, (v, g) in enumerate(picked)], "pos int, node long, gain long, sketches int")


@query()
def rr_continuous(spark, sf_dir):
    """Continuous-time sketches with Weibull delays."""
    edges = trade(spark, sf_dir).select("src", "dst", F.lit(1.5).alias("shape"), (200.0 / F.col("c")).alias("scale"))
    rr = sketches.rr_sets_continuous(edges, transforms.nodes(edges), 20, 0.6)
    return rr.groupBy("rr_id").agg(F.count(F.lit(1)).alias("size"))


@query()
def rr_log_det(spark, sf_dir):
    """Log-determinant reward of each sketch's sampled subgraph."""
    edges = trade(spark, sf_dir)
    live = worlds.live_ic(edges, TRADE_DEN, WORLDS, "rric", "rr_id")
    rr = sketches.rr_sets(edges, transforms.nodes(edges), TRADE_DEN, WORLDS).select("rr_id", "node", "depth")
    root = rr.filter("depth = 0").select("rr_id", F.col("node").alias("root"))
    inner = live.join(rr.select("rr_id", F.col("node").alias("src")), ["rr_id", "src"]).join(rr.select("rr_id", F.col("node").alias("dst")), ["rr_id", "dst"])
    return kernels.log_det(root.join(inner, "rr_id", "left").select("rr_id", "root", "src", "dst"))


@query()
def hub_deletion(spark, sf_dir):
    """Largest weak component while each world's hub is deleted, step by step."""
    return kernels.delete_hubs(worlds.live_ic(trade(spark, sf_dir), 20 * TRADE_DEN, SIM_WORLDS), 5)


def by_strategy_sql() -> str:
    """Each strategy's sketches: common coins on its blocked graph, roots among the nodes that are left."""
    return f"""WITH RECURSIVE {SUPP}, {DEG}, {N}, {live_sql(SUPP_SPARSE, SKETCHES, "rric", "rr_id")}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n), {BLOCKED_SQL},
    z AS (SELECT CAST(range AS INTEGER) AS rr_id, CAST(floor({u32_sql('root', 'range')} * (SELECT count(*) FROM n) / 4294967296.0) AS BIGINT) AS k FROM range({SKETCHES})),
    q AS (SELECT strategy, rr_id, id FROM (SELECT DISTINCT strategy FROM bl) t, z JOIN i USING (k) WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.strategy = t.strategy AND bl.node = id)),
    r(strategy, rr_id, node) AS (SELECT * FROM q UNION SELECT r.strategy, r.rr_id, src FROM r JOIN live ON live.rr_id = r.rr_id AND dst = node WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.strategy = r.strategy AND bl.node = src)),
    sizes AS (SELECT t.strategy, (SELECT count(*) FROM n WHERE id NOT IN (SELECT node FROM bl WHERE bl.strategy = t.strategy)) AS n, (SELECT count(*) FROM q WHERE q.strategy = t.strategy) AS r FROM (SELECT DISTINCT strategy FROM bl) t),
    inf AS (SELECT s.strategy, (SELECT count(DISTINCT rr_id) FROM r WHERE r.strategy = s.strategy AND node IN ({', '.join(map(str, SEEDS))})) * s.n / CAST(s.r AS DOUBLE) AS influence FROM sizes s)"""


def _by_strategy(spark, sf_dir):
    edges = supp(spark, sf_dir)
    return robust.strategy_sketches(edges, transforms.nodes(edges), _blocked(edges), SUPP_SPARSE, SKETCHES)


@query(f"{by_strategy_sql()} SELECT strategy, round(influence, 6) AS influence FROM inf")
def influence_by_strategy(spark, sf_dir):
    rr, sizes = _by_strategy(spark, sf_dir)
    return _rounded(seeding.strategy_influence(rr, _seeds(spark), sizes), "influence")


@query(f"{by_strategy_sql()} SELECT round(min(influence), 6) AS objective FROM inf")
def worst_case_objective(spark, sf_dir):
    rr, sizes = _by_strategy(spark, sf_dir)
    return _rounded(seeding.worst_case_objective(seeding.strategy_influence(rr, _seeds(spark), sizes)), "objective")


@query(f"{by_strategy_sql()} SELECT round(sum(least(20.0, influence)), 6) AS total FROM inf")
def truncated_sum(spark, sf_dir):
    rr, sizes = _by_strategy(spark, sf_dir)
    return _rounded(seeding.truncated_sum(seeding.strategy_influence(rr, _seeds(spark), sizes), 20.0), "total")


@query(f"{by_strategy_sql()}, k AS (SELECT strategy, rr_id, count(*) AS k FROM r GROUP BY ALL) SELECT rr_id, arg_min(strategy, (k, strategy)) AS strategy, min(k) AS size FROM k GROUP BY rr_id")
def rr_worst_case(spark, sf_dir):
    rr, _ = _by_strategy(spark, sf_dir)
    return sketches.worst_case(rr).groupBy("rr_id", "strategy").agg(F.count(F.lit(1)).alias("size"))


@query(
    f"""{by_strategy_sql()}, g AS (SELECT m.node, min(coalesce(k, 0) * s.n / CAST(s.r AS DOUBLE)) AS w, sum(coalesce(k, 0) * s.n / CAST(s.r AS DOUBLE)) AS t
      FROM (SELECT DISTINCT node FROM r) m, sizes s LEFT JOIN (SELECT strategy, node, count(*) AS k FROM r GROUP BY ALL) x ON x.node = m.node AND x.strategy = s.strategy GROUP BY m.node)
    SELECT node, round(w, 6) AS objective FROM g ORDER BY w DESC, t DESC, node DESC LIMIT 1"""
)
def single_greedy(spark, sf_dir):
    rr, sizes = _by_strategy(spark, sf_dir)
    seeds, value = seeding.single_greedy(rr, sizes, 1)
    return spark.createDataFrame([(seeds[0], round(value, 6))], "node long, objective double")


@query(
    f"""{by_strategy_sql()}, c AS (SELECT strategy, arg_max(node, (k, node)) AS node FROM (SELECT strategy, node, count(*) AS k FROM r GROUP BY strategy, node) GROUP BY strategy),
    v AS (SELECT c.strategy, c.node, min((SELECT count(*) FROM r WHERE r.strategy = s.strategy AND r.node = c.node) * s.n / CAST(s.r AS DOUBLE)) AS objective FROM c, sizes s GROUP BY ALL)
    SELECT strategy, node, round(objective, 6) AS objective FROM v ORDER BY v.objective DESC, strategy LIMIT 1"""
)
def all_greedy(spark, sf_dir):
    rr, sizes = _by_strategy(spark, sf_dir)
    strategy, seeds, value = seeding.all_greedy(rr, sizes, 1)
    return spark.createDataFrame([(strategy, seeds[0], round(value, 6))], "strategy string, node long, objective double")


@query()
def saturate_seeds(spark, sf_dir):
    rr, sizes = _by_strategy(spark, sf_dir)
    seeds, value = seeding.saturate(rr, sizes, 1, gamma=0.02, beta=4)
    return spark.createDataFrame([(i, v, round(value, 6)) for i, v in enumerate(seeds)], "pos int, node long, objective double")


DYNAMIC_SQL = f"""WITH RECURSIVE {SUPP}, {DEG}, {N}, {live_sql(SUPP_SPARSE, 50, "rric", "rr_id")}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n),
    z AS (SELECT CAST(range AS INTEGER) AS rr_id, CAST(floor({u32_sql('root', 'range')} * (SELECT count(*) FROM n) / 4294967296.0) AS BIGINT) AS k FROM range(50)),
    lv AS (SELECT unnest(range(0, k, greatest(1, k // 10))) AS l FROM (SELECT count(*) AS k FROM n)),
    r(l, rr_id, node) AS (SELECT l, rr_id, id FROM lv, z JOIN i USING (k) JOIN o ON o.node = id WHERE o.rank >= l
      UNION SELECT r.l, r.rr_id, src FROM r JOIN live ON live.rr_id = r.rr_id AND dst = r.node JOIN o ON o.node = src WHERE o.rank >= r.l),
    g AS (SELECT l, node, count(*) AS k FROM r GROUP BY ALL), b AS (SELECT l, arg_max(node, (k, node)) AS node, max(k) AS k FROM g GROUP BY l)"""


@query(
    f"""{DYNAMIC_SQL} SELECT CAST(l AS INTEGER) AS l, node, round(k * ((SELECT count(*) FROM n) - l) / CAST((SELECT count(*) FROM r x JOIN z ON z.rr_id = x.rr_id JOIN i ON i.k = z.k AND i.id = x.node WHERE x.l = b.l) AS DOUBLE), 6) AS influence FROM b"""
)
def dynamic_im_sequence(spark, sf_dir):
    """Best single seed and its influence at every tenth level of one removal order, from one set of sketches."""
    edges = supp(spark, sf_dir)
    ids = cut(transforms.nodes(edges))
    n = ids.count()
    found = robust.dynamic_influence(edges, ids, _order(edges), SUPP_SPARSE, 50, list(range(0, n, max(1, n // 10))))
    return _rounded(found.drop("pos"), "influence")


@query(
    f"""{closure_sql(TRADE_DEN, WORLDS)}, c AS (SELECT w, l, s, count(*) AS k FROM reach GROUP BY ALL), m AS (SELECT w, l, max(k) AS k FROM c GROUP BY ALL), q AS (SELECT l, avg(k) AS s, stddev_pop(k) AS d FROM m GROUP BY l)
    SELECT round(sum(s) / count(*), 6) AS rob, round(avg(d), 6) AS rob_std, count(*) AS levels FROM q"""
)
def resilience_trade(spark, sf_dir):
    edges = trade(spark, sf_dir)
    reach = kernels.max_reach(worlds.live_ic(edges, TRADE_DEN, WORLDS), _order(edges), WORLDS)
    levels = reach.groupBy("l").agg(F.avg("max_reach").alias("s"), F.stddev_pop("max_reach").alias("d"))
    return _rounded(levels.agg((F.sum("s") / F.count(F.lit(1))).alias("rob"), F.avg("d").alias("rob_std"), F.count(F.lit(1)).alias("levels")), "rob", "rob_std")


@query(
    f"""WITH RECURSIVE {TRADE}, {live_sql(100 * TRADE_DEN, WORLDS)}, b AS (SELECT world, src AS u, dst AS v FROM live UNION SELECT world, dst, src FROM live),
    r(world, u, v) AS (SELECT world, u, v FROM b UNION SELECT r.world, r.u, b.v FROM r JOIN b ON b.world = r.world AND r.v = b.u),
    c AS (SELECT world, u, least(u, min(v)) AS k FROM r GROUP BY world, u), s AS (SELECT world, k, count(*) AS size FROM c GROUP BY world, k), t AS (SELECT world, arg_max(k, (size, -k)) AS k FROM s GROUP BY world)
    SELECT u AS node, count(*) AS worlds FROM c JOIN t USING (world, k) GROUP BY u"""
)
def participation(spark, sf_dir):
    """In how many worlds each node is in the largest weak component."""
    live = worlds.live_ic(trade(spark, sf_dir), 100 * TRADE_DEN, WORLDS)
    label = fixpoint.weak_components(live, ["world"])
    size = label.groupBy("world", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = size.groupBy("world").agg(F.max(F.struct("size", (-F.col("component")).alias("m"), "component")).alias("b")).select("world", F.col("b.component").alias("component"))
    return label.join(largest, ["world", "component"]).groupBy("node").agg(F.count(F.lit(1)).alias("worlds"))


@query(
    f"""WITH {TRADE}, {live_sql(TRADE_DEN, 5)} SELECT world, src, dst FROM live"""
)
def world_edges_table_function(spark, sf_dir):
    """Live edges through the SQL table function."""
    from ..operators.tables import register

    register(spark)
    trade(spark, sf_dir).createOrReplaceTempView("cascata_trade")
    return spark.sql(f"SELECT w.world, e.src, e.dst FROM cascata_trade e, LATERAL world_edges(e.src, e.dst, e.c, {TRADE_DEN}, 5) w WHERE w.live")


@query(
    f"""WITH RECURSIVE {SUPP}, {live_sql(SUPP_SPARSE, 1)}, s AS (SELECT src, dst FROM live),
    r(u, v) AS (SELECT src, dst FROM s UNION SELECT u, dst FROM r JOIN s ON v = src), n AS (SELECT src AS u FROM s UNION SELECT dst FROM s),
    k AS (SELECT n.u, least(n.u, coalesce(min(x.v), n.u)) AS scc FROM n LEFT JOIN (SELECT a.u, a.v FROM r a JOIN r b ON a.u = b.v AND a.v = b.u) x ON x.u = n.u GROUP BY n.u)
    SELECT a.scc AS src, b.scc AS dst, count(*) AS multiplicity FROM s JOIN k a ON a.u = s.src JOIN k b ON b.u = s.dst WHERE a.scc <> b.scc GROUP BY 1, 2"""
)
def condensation(spark, sf_dir):
    """Edges between the strongly connected components of one world, with multiplicities."""
    from ..operators.condense import condensed

    edges = cut(worlds.live_ic(supp(spark, sf_dir), SUPP_SPARSE, 1).select("src", "dst"))
    return condensed(edges, fixpoint.strong_components(edges, transforms.nodes(edges)))[0]


@query(
    f"""WITH RECURSIVE {SUPP}, {DEG}, {N}, {live_sql(SUPP_SPARSE, 5)}, {BLOCKED_SQL}, t AS (SELECT DISTINCT strategy FROM bl),
    s AS (SELECT 'top' AS seeding, node FROM o WHERE rank BETWEEN 15 AND 17 UNION ALL SELECT 'late', node FROM o WHERE rank BETWEEN 40 AND 42),
    r(seeding, strategy, w, v) AS (SELECT seeding, strategy, range, node FROM t, range(5), s WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.strategy = t.strategy AND bl.node = s.node)
      UNION SELECT r.seeding, r.strategy, w, dst FROM r JOIN live ON world = w AND src = v WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.strategy = r.strategy AND bl.node = dst)),
    k AS (SELECT seeding, strategy, count(*) / 5.0 AS k FROM r GROUP BY ALL)
    SELECT seeding, round(min(k), 6) AS worst, count(*) AS strategies FROM k GROUP BY seeding"""
)
def pairwise_simulation(spark, sf_dir):
    """Every seed set against every blocked set in common worlds; the worst case of each seed set."""
    edges = supp(spark, sf_dir)
    order = immunize.degree(edges)
    seeds = order.filter("rank BETWEEN 15 AND 17").select(F.lit("top").alias("seeding"), "node").union(order.filter("rank BETWEEN 40 AND 42").select(F.lit("late"), "node"))
    blocked = _blocked(edges)
    live = worlds.without_blocked(worlds.live_ic(edges, SUPP_SPARSE, 5), blocked)
    start = seeds.crossJoin(F.broadcast(blocked.select("strategy").distinct())).join(blocked, ["strategy", "node"], "left_anti")
    every = worlds.worlds(start, 5)
    active = fixpoint.reach(every, live, ["seeding", "strategy", "world"], ["strategy", "world"])
    per = active.groupBy("seeding", "strategy").agg((F.count(F.lit(1)) / F.lit(5.0)).alias("k"))
    return _rounded(per.groupBy("seeding").agg(F.min("k").alias("worst"), F.count(F.lit(1)).alias("strategies")), "worst")


@query()
def rewired_assortativity(spark, sf_dir):
    """Assortativity before and after degree-preserving rewiring."""
    from ..operators.search import improve_assortativity
    from ..operators.statistics import assortativity

    edges = supp(spark, sf_dir).select("src", "dst")
    after = improve_assortativity(edges, 200, rounds=3)
    return assortativity(edges).withColumn("state", F.lit("before")).union(assortativity(after).withColumn("state", F.lit("after")))


@query()
def greedy_removal_order(spark, sf_dir):
    """Removals that each keep the expected largest reach highest, on the whole trade graph, until three nodes are left."""
    from ..operators.search import greedy_removal

    edges = trade(spark, sf_dir).cache()
    ids = sorted(r["id"] for r in transforms.nodes(edges).collect())  # nations
    place = {v: i for i, v in enumerate(ids)}
    reach = np.repeat(np.eye(len(ids), dtype=bool)[None], 5, 0)
    for r in worlds.live_ic(edges, TRADE_DEN, 5).select("world", "src", "dst").collect():
        reach[r["world"], place[r["src"]], place[r["dst"]]] = True

    def score(gone):
        rest = [place[v] for v in ids if v not in gone]
        now = reach[:, rest][:, :, rest]
        for _ in range(len(rest).bit_length()):
            now = now @ now
        return float(now.sum(2).max(1).mean())

    found = greedy_removal(ids, score, max(0, len(ids) - 3))
    return spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate(found)], "pos int, node long, value double")


@query(
    f"""WITH RECURSIVE {SUPP}, {DEG}, {N}, {live_sql(SUPP_SPARSE, 50, "rric", "rr_id")}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n),
    p AS (SELECT 'Degree' AS strategy, node, rank FROM o UNION ALL SELECT 'Random', id, row_number() OVER (ORDER BY {u32_sql('random', 'id')}, id) - 1 FROM n),
    z AS (SELECT CAST(range AS INTEGER) AS rr_id, CAST(floor({u32_sql('root', 'range')} * (SELECT count(*) FROM n) / 4294967296.0) AS BIGINT) AS k FROM range(50)),
    q AS (SELECT strategy, l, rr_id, id FROM (SELECT unnest(range(0, k, greatest(1, k // 5))) AS l FROM (SELECT count(*) AS k FROM n)) lv, z JOIN i USING (k) JOIN p ON p.node = id WHERE p.rank >= l),
    r(strategy, l, rr_id, node) AS (SELECT * FROM q UNION SELECT r.strategy, r.l, r.rr_id, src FROM r JOIN live ON live.rr_id = r.rr_id AND dst = r.node JOIN p ON p.strategy = r.strategy AND p.node = src WHERE p.rank >= r.l),
    s AS (SELECT l, strategy, count(*) AS r FROM q GROUP BY ALL), v AS (SELECT r.l, r.strategy, r.node, count(*) * ((SELECT count(*) FROM n) - r.l) / CAST(any_value(s.r) AS DOUBLE) AS i FROM r JOIN s ON s.l = r.l AND s.strategy = r.strategy GROUP BY r.l, r.strategy, r.node),
    w AS (SELECT l, node, CASE WHEN count(*) = 2 THEN min(i) ELSE 0 END AS w FROM v GROUP BY l, node)
    SELECT CAST(l AS INTEGER) AS l, arg_max(node, (round(w, 9), node)) AS node, round(max(w), 6) AS objective FROM w GROUP BY l"""
)
def dynamic_worst_case(spark, sf_dir):
    """Best single seed against the worse of two removal orders, by level."""
    edges = supp(spark, sf_dir)
    one = immunize.degree(edges).select(F.lit("Degree").alias("strategy"), "node", F.col("rank").cast("int").alias("rank"))
    two = immunize.random_order(edges).select(F.lit("Random").alias("strategy"), "node", F.col("rank").cast("int").alias("rank"))
    ids = cut(transforms.nodes(edges))
    n = ids.count()
    found = robust.dynamic_worst_case(edges, ids, one.union(two), SUPP_SPARSE, 50, list(range(0, n, max(1, n // 5))))
    return _rounded(found, "objective")


@query(
    f"""{by_strategy_sql()}, k AS (SELECT strategy, rr_id, count(*) AS k FROM r GROUP BY ALL), b AS (SELECT rr_id, arg_min(strategy, (k, strategy)) AS strategy FROM k GROUP BY rr_id),
    g AS (SELECT node, count(*) AS gain FROM r JOIN b USING (rr_id, strategy) GROUP BY node) SELECT node, gain FROM g ORDER BY gain DESC, node DESC LIMIT 1"""
)
def adversarial_seed(spark, sf_dir):
    """Greedy cover of the worst-case sketches."""
    rr, _ = _by_strategy(spark, sf_dir)
    found = seeding.greedy_cover(sketches.worst_case(rr).select("rr_id", "node"), 1)
    return spark.createDataFrame([(v, int(g)) for v, g in found], "node long, gain long")


LOG_DEN = 2500
LOGGED = f"""e AS (SELECT src, dst, CAST(floor(weight) AS BIGINT) AS c FROM ({ORACLES["edges_after_changelog"]})),
    n AS (SELECT user_id AS id FROM events UNION SELECT CAST(floor(value) AS BIGINT) % 40 FROM events)"""


@query(f"{rr_sql(live_sql(LOG_DEN, SKETCHES, 'rric', 'rr_id')).replace(f'{SUPP}, {N}', LOGGED)} SELECT node, count(*) AS covered FROM r GROUP BY node")
def sketches_after_changelog(spark, sf_dir):
    """Sketches of the graph after half of the log, brought up to date with the rest of it."""
    from ..operators import dynamic
    from ..streaming import changelog
    from .analytics import _log

    log = cut(_log(spark, sf_dir))
    ids = cut(log.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    none = spark.createDataFrame([], "src long, dst long, weight double")
    half = log.agg(F.floor(F.avg("seq"))).first()[0]
    graph = lambda rows: cut(changelog.apply_log(none, ids, rows)[0].select("src", "dst", F.floor("weight").cast("long").alias("c")))
    old, new = graph(log.filter(F.col("seq") <= half)), graph(log)
    rr = cut(sketches.rr_sets(old, ids, LOG_DEN, SKETCHES).select("rr_id", "node"))
    return sketches.influence(dynamic.refreshed(rr, (old, ids), (new, ids), LOG_DEN, SKETCHES), 1, SKETCHES).select("node", "covered")

"""Experiment stages: data sets, immunization, evaluation, analysis; each stage materialises a collection.

The axes (graph, strategy, world, level) are columns, so a stage is a few DataFrame jobs per graph.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analytics import envelope
from .operators import immunize, robust, seeding, sketches, statistics, transforms, worlds
from .params import Parameters
from .runtime import cut, fresh_folder
from .sources.generators import generate
from .sources.store import Store

#: Integer denominator that stored weights are rounded to.
DEN = 1_000_000
#: Names of strategies in experiments, and of the registry.
NAMES = {"NetShield": "Netshield", "Aquaintance": "Acquaintance"}


#: Parameters that turn on a method of the worst-case seeding, and its objective; the best of those that are on counts.
METHODS = (
    (("singlegreedy", "singlegreedycelf"), lambda rr, sizes, k, s: seeding.single_greedy(rr, sizes, k)[1]),
    (("allgreedy",), lambda rr, sizes, k, s: seeding.all_greedy(rr, sizes, k)[2]),
    (("satgreedy",), lambda rr, sizes, k, s: seeding.saturate(rr, sizes, k, float(s.get("gamma", 0.1)))[1]),
)


class Experiment:
    def __init__(self, spark: SparkSession, given: dict, folder: str | None = None):
        self.spark, self.p = spark, Parameters(given)
        self.tag = self.p.params["tag"]
        self.folder = folder or fresh_folder(spark, "experiment")
        self.store = Store(spark, self.folder)
        if self.p.params.get("full_rerun"):
            for name in ("parameters", "graphs", "immunization", "seeding"):
                self.store.remove(name, self.tag)
        self.store.insert("parameters", spark.createDataFrame([(json.dumps(self.p.params, sort_keys=True),)], "json string"), self.tag)
        self.graphs: dict[str, DataFrame] = {}

    def datasets(self) -> None:
        """One graph per data set, with its analysis row if asked for."""
        rows = []
        for params in self.p.data_sets():
            own = {k: v for k, v in params.items() if k not in ("graph_type", "weight_scale", "random_weight", "both_directions", "k", "assort")}
            edges = generate(self.spark, params["graph_type"], params["weight_scale"], params["random_weight"], **own)
            if params["both_directions"]:
                edges = transforms.both_directions(edges)
            graph_id = uuid.uuid4().hex
            self.graphs[graph_id] = cut(edges.withColumn("c", F.round(F.col("weight") * DEN).cast("long")))
            rows.append((graph_id, json.dumps(params, sort_keys=True), self.graphs[graph_id]))
        out = []
        for graph_id, params, edges in rows:
            stats = statistics.analysed(edges).first().asDict() if self.p.params.get("graph_analysis") else {}
            out.append((graph_id, params, *(stats.get(k) for k in ("n", "m", "avg_degree", "average_clustering"))))
        schema = "graph_id string, params string, n long, m long, avg_degree double, average_clustering double"
        self.store.insert("graphs", self.spark.createDataFrame(out, schema), self.tag)

    def orders(self, graph_id: str) -> DataFrame:
        """strategy, rank, node of all strategies."""
        edges = self.graphs[graph_id]
        parts = []
        for s in self.p.immunization_sets():
            name = s["solver_name"]
            if name == "Random":
                found = immunize.random_order(edges, f"random{s.get('random_id', 1)}")
            else:
                found = immunize.STRATEGIES[NAMES.get(name, name)](edges)
            parts.append(found.select(F.lit(name).alias("strategy"), F.col("rank").cast("int").alias("rank"), "node"))
        return robust.union_all(parts)

    def immunization(self) -> None:
        for graph_id in self.graphs:
            self.store.insert("immunization", self.orders(graph_id).withColumn("graph_id", F.lit(graph_id)), self.tag)

    def seeding(self) -> None:
        """Result series of every solver set: Rob gives expected largest reach by level, Imm and SatGreedy best seeds."""
        for graph_id, edges in self.graphs.items():
            removal = cut(self.store.find("immunization", self.tag).filter(F.col("graph_id") == graph_id))
            ids = cut(transforms.nodes(edges))
            n = ids.count()
            for s in self.p.solver_sets():
                made = self._solve(edges, ids, n, removal, s)
                if made is not None:
                    row = made.withColumns({"graph_id": F.lit(graph_id), "solver": F.lit(s["solver"]), "params": F.lit(json.dumps(s, sort_keys=True))})
                    self.store.insert("seeding", row, self.tag)

    def _solve(self, edges: DataFrame, ids: DataFrame, n: int, removal: DataFrame, s: dict) -> DataFrame | None:
        names = [r["strategy"] for r in removal.select("strategy").distinct().orderBy("strategy").collect()]
        live = worlds.live_lt if s.get("lt_model") else worlds.live_ic
        levels = seeding.levels(s.get("alpha", 1), n) if s["number_of_blocked_nodes"] < 0 else [s["number_of_blocked_nodes"]]
        if s["solver"] == "Rob" and s.get("mode"):
            w = int(s.get("iterations", 100))
            parts = []
            for name in names:
                order = removal.filter(F.col("strategy") == name).select("node", "rank")
                reach = robust.greedy_reach(live(edges, DEN, w), order, w, int(s["seeds"]), levels)
                parts.append(reach.groupBy("l").agg(F.avg("reach").alias("value"), F.stddev_pop("reach").alias("sd")).withColumn("strategy", F.lit(name)))
            return robust.union_all(parts)
        seeds = int(s["seeds"])
        model = "lt" if s.get("lt_model") else "ic"
        if s["solver"] == "Rob" or s["solver"] == "Imm":
            r = self._sketches(edges, ids, n, seeds, s, model)
            parts = []
            for name in names:
                order = removal.filter(F.col("strategy") == name).select("node", "rank")
                found = robust.dynamic_influence(edges, ids, order, DEN, r, levels, seeds, model).filter(F.col("pos") == seeds - 1)
                parts.append(found.select("l", F.col("influence").alias("value"), F.lit(None).cast("double").alias("sd"), F.lit(name).alias("strategy")))
            return robust.union_all(parts)
        if s["solver"] == "SatGreedy":
            out = []
            r = self._sketches(edges, ids, n, seeds, s, model)
            for level in levels:
                blocked = removal.filter(F.col("rank") < level).select("strategy", "node").union(self.spark.createDataFrame([(x, -1) for x in names], "strategy string, node long"))
                if n - level <= seeds:
                    out.append((level, 0.0))
                    continue
                rr, sizes = robust.strategy_sketches(edges, ids, blocked, DEN, r, model)
                rr = cut(rr)
                out.append((level, max(float(solve(rr, sizes, seeds, s)) for flags, solve in METHODS if any(s.get(f) for f in flags))))
            return self.spark.createDataFrame(out, "l int, value double").withColumns({"sd": F.lit(None).cast("double"), "strategy": F.lit("worst")})
        raise ValueError(f"unknown solver {s['solver']!r}")

    def _sketches(self, edges: DataFrame, ids: DataFrame, n: int, seeds: int, s: dict, model: str) -> int:
        """Sketches that the solver's epsilon asks for on the whole graph."""
        sample = lambda first, r: sketches.rr_sets(edges, ids, DEN, r, model, first).select("rr_id", "node")
        return seeding.imm(sample, n, seeds, float(s.get("epsilon", 0.2)))[1]

    def results(self) -> DataFrame:
        """Result series joined with their graph's row."""
        graphs = self.store.find("graphs", self.tag).select("graph_id", F.col("params").alias("graph_params"), "n", "m")
        return self.store.find("seeding", self.tag).join(graphs, "graph_id")

    def summary(self) -> DataFrame:
        """graph_id, solver, params, rob: worst case over the strategies by level, summed up over n."""
        series = self.results()
        low = envelope(series, ["graph_id", "solver", "params", "n"])
        return low.groupBy("graph_id", "solver", "params").agg((F.sum("value") / F.max("n")).alias("rob"))

    def run(self) -> DataFrame:
        self.datasets()
        self.immunization()
        self.seeding()
        return self.summary()



"""Queries of the analytics layer: series over levels, result joins, reshaping, scalar functions, change-logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analytics as fn
from ..functions import results as res
from ..runtime import numbered
from ..sources.derived import table
from ..streaming import changelog
from .registry import query

SERIES = "s AS (SELECT event_type AS strategy, CAST(floor(epoch(ts) / 21600) AS INTEGER) AS l, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"


def series(spark, sf_dir):
    """Events of a type by quarter of a day."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("strategy"), F.floor(F.unix_timestamp("ts") / 21600).cast("int").alias("l")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {SERIES} SELECT l, min(value) AS value FROM s GROUP BY l")
def envelope_min(spark, sf_dir):
    return fn.envelope(series(spark, sf_dir), [])


@query(f"WITH {SERIES} SELECT l, max(value) AS value FROM s GROUP BY l")
def envelope_max(spark, sf_dir):
    return fn.envelope(series(spark, sf_dir), [], "max")


@query(f"WITH {SERIES} SELECT strategy, round(sum(value) / 100, 6) AS rob FROM s GROUP BY strategy")
def series_resilience(spark, sf_dir):
    return _round(fn.resilience(series(spark, sf_dir), ["strategy"], 100), "rob")


@query(
    f"""WITH {SERIES} SELECT strategy, l, value, CASE WHEN row_number() OVER w > 5 THEN round(avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) END AS average
    FROM s WINDOW w AS (PARTITION BY strategy ORDER BY l)"""
)
def moving_average(spark, sf_dir):
    return _round(fn.moving_average(series(spark, sf_dir), ["strategy"], 5), "average")


@query(f"WITH {SERIES} SELECT strategy, l, value, round(avg(value) OVER (PARTITION BY strategy ORDER BY l ROWS UNBOUNDED PRECEDING), 6) AS average FROM s")
def running_mean(spark, sf_dir):
    return _round(fn.running_mean(series(spark, sf_dir), ["strategy"]), "average")


@query(f"WITH {SERIES} SELECT strategy, l, value, value - lag(value) OVER (PARTITION BY strategy ORDER BY l) AS diff FROM s")
def series_difference(spark, sf_dir):
    return fn.difference(series(spark, sf_dir), ["strategy"])


@query(f"WITH {SERIES} SELECT strategy, l, value, round((first_value(value) OVER w - value) / first_value(value) OVER w, 6) AS loss FROM s WINDOW w AS (PARTITION BY strategy ORDER BY l)")
def relative_loss(spark, sf_dir):
    return _round(fn.relative_loss(series(spark, sf_dir), ["strategy"]), "loss")


@query(f"WITH {SERIES} SELECT strategy, l, value, round(lead(value) OVER (PARTITION BY strategy ORDER BY l) / value, 6) AS ratio FROM s")
def next_ratio(spark, sf_dir):
    return _round(fn.next_ratio(series(spark, sf_dir), ["strategy"]), "ratio")


@query(
    """WITH r AS (SELECT c_mktsegment AS measure, o_orderpriority AS immunization, count(*) AS runtime FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT measure, immunization, runtime, CAST(sum(runtime) OVER (PARTITION BY measure ORDER BY immunization ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stacked FROM r"""
)
def stacked_runtimes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runtime = rows.groupBy(F.col("c_mktsegment").alias("measure"), F.col("o_orderpriority").alias("immunization")).agg(F.count(F.lit(1)).alias("runtime"))
    return fn.stacked(runtime, ["measure"], "immunization", "runtime")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def keep_last(spark, sf_dir):
    return fn.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


PAIRS = f"{SERIES}, p AS (SELECT a.strategy, a.l, a.value AS p, b.value AS q FROM s a JOIN (SELECT l, sum(value) AS value FROM s GROUP BY l) b USING (l))"


def _pairs(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.join(s.groupBy("l").agg(F.sum("value").alias("q")), "l").select("strategy", "l", F.col("value").alias("p"), "q")


@query(
    f"""WITH {PAIRS}, n AS (SELECT strategy, p / sum(p) OVER (PARTITION BY strategy) AS p, q / sum(q) OVER (PARTITION BY strategy) AS q FROM p)
    SELECT strategy, round((sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) / 2, 6) AS jsd FROM n GROUP BY strategy"""
)
def jensen_shannon(spark, sf_dir):
    return _round(fn.jensen_shannon(_pairs(spark, sf_dir), ["strategy"]), "jsd")


@query(f"WITH {PAIRS} SELECT strategy, round(1 - sum((p - q / 4) * (p - q / 4)) / (var_pop(p) * count(*)), 6) AS r2 FROM p GROUP BY strategy")
def r2_score(spark, sf_dir):
    return _round(fn.r2_score(_pairs(spark, sf_dir).withColumn("f", F.col("q") / 4), ["strategy"], "p", "f"), "r2")


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _COLUMNS for b in _COLUMNS))
def correlation_matrix(spark, sf_dir):
    return _round(fn.correlations(table(spark, sf_dir, "lineitem"), list(_COLUMNS)), "corr")


SAMPLES = f"{SERIES}, z AS (SELECT strategy, l - (SELECT min(l) FROM s) AS l, value FROM s), k AS (SELECT * FROM z WHERE l % 7 = 0)"


def _samples(spark, sf_dir):
    s = series(spark, sf_dir)
    low = s.agg(F.min("l").alias("low"))
    return s.crossJoin(F.broadcast(low)).select("strategy", (F.col("l") - F.col("low")).cast("int").alias("l"), "value").filter("l % 7 = 0")


@query(
    f"""WITH {SAMPLES}, g AS (SELECT *, lead(l) OVER w AS l2, lead(value) OVER w AS v2 FROM k WINDOW w AS (PARTITION BY strategy ORDER BY l)),
    x AS (SELECT *, unnest(range(l, coalesce(l2, l + 1))) AS pos FROM g) SELECT strategy, CAST(pos AS INTEGER) AS l, round(value + coalesce((pos - l) / CAST(l2 - l AS DOUBLE), 0) * (coalesce(v2, value) - value), 6) AS value FROM x"""
)
def interpolated_series(spark, sf_dir):
    return _round(fn.interpolated(_samples(spark, sf_dir), ["strategy"]), "value")


@query()
def spline_series(spark, sf_dir):
    return fn.spline(_samples(spark, sf_dir), ["strategy"], 50)


@query()
def cubic_fit(spark, sf_dir):
    return fn.cubic_fit(_samples(spark, sf_dir).select("strategy", F.col("l").alias("x"), F.col("value").alias("y")), ["strategy"])


@query("SELECT p_brand, unnest(['p_size', 'p_retailprice']) AS solver, unnest([CAST(sum(p_size) AS DOUBLE), round(sum(p_retailprice), 4)]) AS objective FROM part GROUP BY p_brand")
def unpivoted_solvers(spark, sf_dir):
    sums = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("p_size"), F.round(F.sum("p_retailprice"), 4).alias("p_retailprice"))
    return fn.unpivoted(sums, ["p_brand"], ["p_size", "p_retailprice"])


@query("SELECT o_orderpriority, round(min(o_totalprice), 6) AS least, round(avg(o_totalprice), 6) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 6) AS std FROM orders GROUP BY 1")
def grouped_stats(spark, sf_dir):
    return _round(res.grouped_stats(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice"), "least", "mean", "std")


@query("SELECT p_type, CAST(list_sort(list(p_size))[count(*) // 2 + 1] AS INTEGER) AS median FROM part GROUP BY p_type")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(fn.upper_median("p_size").alias("median"))


@query("SELECT CAST(least(10, floor((l_quantity - 1) / 5) + 1) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.lit(10), F.floor((F.col("l_quantity") - 1) / 5) + 1).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS value, count(*) AS n, count(DISTINCT user_id) AS n_unique FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_unique"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3) AND o_totalprice < 100000")
def filtered_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_custkey").isin(1, 2, 3) & (F.col("o_totalprice") < 100000)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


CMD = "CASE o_orderkey % 3 WHEN 0 THEN 'bin/Robust -s ' WHEN 1 THEN 'bin/Simulator -s ' ELSE 'bin/Rob -s ' END || CAST(o_orderkey % 50 AS VARCHAR) || ' -m 5'"


def _cmd():
    return F.concat(F.when(F.col("o_orderkey") % 3 == 0, "bin/Robust -s ").when(F.col("o_orderkey") % 3 == 1, "bin/Simulator -s ").otherwise("bin/Rob -s "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" -m 5"))


@query(
    f"""WITH s AS (SELECT o_orderkey AS run, {CMD} AS cmd, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 25 ELSE o_custkey END AS related, o_totalprice AS rob FROM orders),
    g AS (SELECT CAST(n_nationkey AS BIGINT) AS graph_id, n_name AS name FROM nation), i AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS graph, c_mktsegment AS solver FROM customer)
    SELECT run, cmd, rob, NULL AS solver, NULL AS simulated, name FROM s JOIN g ON related = graph_id WHERE contains(cmd, 'Robust')
    UNION ALL SELECT run, cmd, rob, NULL, 'yes', name FROM s JOIN i ON related = id JOIN g ON graph = graph_id WHERE contains(cmd, 'Simulator')
    UNION ALL SELECT run, cmd, rob, solver, NULL, name FROM s JOIN i ON related = id JOIN g ON graph = graph_id WHERE contains(cmd, 'bin/Rob ')"""
)
def joined_results(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 25).otherwise(F.col("o_custkey"))
    seeding = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), _cmd().alias("cmd"), key.alias("related_obj_id"), F.col("o_totalprice").alias("rob"))
    graphs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("graph_id"), F.col("n_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("imm_id"), F.col("c_nationkey").cast("long").alias("graph"), F.col("c_mktsegment").alias("solver"))
    requests = customers.select(F.col("imm_id").alias("sim_id"), "graph", F.lit("yes").alias("simulated"))
    return res.joined_results(seeding, customers, requests, graphs, robust="Robust").select("run", "cmd", "rob", "solver", "simulated", "name")


@query(f"SELECT o_orderkey, CAST(regexp_extract({CMD}, '-s ([0-9]+)', 1) AS BIGINT) AS seeds, instr({CMD}, 'Rob') > 0 AS is_rob FROM orders")
def command_fields(spark, sf_dir):
    cmd = _cmd()
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.flag_value(cmd, "s").alias("seeds"), (F.instr(cmd, "Rob") > 0).alias("is_rob"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, round(event_id / 3.6e12, 12) AS hours FROM events")
def json_and_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.round(F.col("event_id") / 3.6e12, 12).alias("hours"))


@query(
    r"""SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda x: substr(x, 1, 1)), '') AS abbreviation,
    replace(array_to_string(list_sort(string_split(p_brand || '-s' || CAST(p_size AS VARCHAR) || '.5', '-')), '_'), '.', '') AS footprint,
    CAST('0x' || substr(md5(p_name), 1, 15) AS BIGINT) AS number FROM part"""
)
def name_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tokens = F.concat("p_brand", F.lit("-s"), F.col("p_size").cast("string"), F.lit(".5"))
    return p.select("p_partkey", fn.initials(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("abbreviation"), fn.footprint(tokens).alias("footprint"), fn.md5_number(F.col("p_name")).alias("number"))


@query(
    """WITH a AS (SELECT o_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    p AS (SELECT k, f, unnest(range(len(f) // 2)) AS i FROM a WHERE len(f) >= 2) SELECT k, f[2 * i + 1] AS src, f[2 * i + 2] AS dst FROM p"""
)
def flat_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    lists = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("f"))
    return lists.filter(F.size("f") >= 2).select("k", F.explode(fn.pairs_of(F.col("f"))).alias("e")).select("k", "e.src", "e.dst")


@query(
    """WITH m AS (SELECT o_custkey AS run, o_orderpriority AS strategy, o_orderdate, o_orderkey, o_totalprice FROM orders)
    SELECT run, strategy, CAST(count(*) AS BIGINT) AS n, round(max(o_totalprice), 4) AS top FROM m GROUP BY 1, 2"""
)
def per_strategy_lists(spark, sf_dir):
    """A list of maps (one per order) turned into one list per strategy, then measured."""
    orders = table(spark, sf_dir, "orders")
    maps = orders.groupBy(F.col("o_custkey").alias("run")).agg(F.collect_list(F.create_map("o_orderpriority", F.round("o_totalprice", 4))).alias("objective"))
    lists = res.map_of_lists(maps, ["run"], "objective")
    present = F.filter("values", lambda v: v.isNotNull())
    return lists.select("run", F.col("name").alias("strategy"), F.size(present).cast("long").alias("n"), F.array_max(present).alias("top"))


@query("SELECT p_type AS param, p_brand AS solver, CAST(max(p_size) AS INTEGER) AS value FROM part GROUP BY 1, 2")
def inverted_params(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("v"))
    by_solver = p.groupBy(F.col("p_brand").alias("solver")).agg(F.map_from_entries(F.collect_list(F.struct("p_type", "v"))).alias("params"))
    return res.inverted(by_solver).select("param", F.explode("values").alias("solver", "value"))


@query("SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def concatenated_frames(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("SELECT n_name, r_name, s AS solver FROM nation, region, (SELECT unnest(['Rob', 'Imm']) AS s)")
def parameter_product(spark, sf_dir):
    """Graphs times strategies times solver parameters."""
    solvers = spark.createDataFrame([("Rob",), ("Imm",)], "solver string")
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_name"))).crossJoin(F.broadcast(solvers))


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS rank, o_orderkey FROM orders")
def global_ranking(spark, sf_dir):
    """A total order over all rows without one task that sorts them."""
    return numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "rank").select("rank", "o_orderkey")


@query(
    """SELECT CASE WHEN regexp_matches(event_type, '^(c|p)') THEN 0 ELSE 1 END AS place, event_type FROM (SELECT DISTINCT event_type FROM events) ORDER BY 1, 2"""
)
def ordered_solvers(spark, sf_dir):
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    return names.select(F.when(F.col("event_type").rlike("^(c|p)"), 0).otherwise(1).alias("place"), "event_type").orderBy("place", "event_type")


# change-logs

LOG = """lg AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'ie' WHEN 'view' THEN 'ie' WHEN 'purchase' THEN 'de' ELSE 'ce' END AS op, user_id AS src, CAST(floor(value) AS BIGINT) % 40 AS dst, value AS weight FROM events)"""


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), "ie").when(F.col("event_type") == "purchase", "de").otherwise("ce")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("op"), F.col("user_id").alias("src"), (F.floor("value").cast("long") % 40).alias("dst"), F.col("value").alias("weight"))


@query(
    f"""WITH {LOG}, k AS (SELECT * FROM lg WHERE src <> dst), d AS (SELECT src, dst, max(seq) AS d FROM k WHERE op = 'de' GROUP BY 1, 2),
    a AS (SELECT k.*, d FROM k LEFT JOIN d USING (src, dst) WHERE op <> 'de' AND (d IS NULL OR seq > d)),
    f AS (SELECT src, dst, min(seq) AS s, arg_min(weight, seq) AS w FROM a WHERE op = 'ie' GROUP BY 1, 2),
    c AS (SELECT a.src, a.dst, arg_max(a.weight, a.seq) AS w FROM a JOIN f ON a.src = f.src AND a.dst = f.dst AND a.seq > f.s WHERE a.op = 'ce' GROUP BY 1, 2)
    SELECT f.src, f.dst, CASE WHEN c.src IS NOT NULL THEN c.w ELSE f.w END AS weight FROM f LEFT JOIN c ON f.src = c.src AND f.dst = c.dst"""
)
def edges_after_changelog(spark, sf_dir):
    """Edge insertions, deletions and re-weightings on an empty graph of all nodes that the log names."""
    none = spark.createDataFrame([], "src long, dst long, weight double")
    log = _log(spark, sf_dir)
    ids = log.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    edges, _ = changelog.apply_log(none, ids, log)
    return edges


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_log(spark, sf_dir):
    return changelog.windowed_log(table(spark, sf_dir, "events"), "6 hours").withColumn("total", F.round("total", 4))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g.g"""
)
def session_log(spark, sf_dir):
    return changelog.sessions(table(spark, sf_dir, "events"), "2 hours")

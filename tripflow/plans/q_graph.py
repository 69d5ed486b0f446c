"""Station-graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import r_round
from ..operators import graph as G
from ..operators import windows as W
from ..sources.fixtures import table
from .oracle_ctes import with_xform
from .registry import register
from .stages import transformed

S, D = "origin_station", "destination_station"
PR_ROUNDS = 120

_EDGES = (
    ", e0 AS (SELECT origin_station, destination_station, count(*) AS trip_count, "
    "round(avg(actual_arrival_delay_min), 2) + 0.0 AS avg_arrival_delay, round(avg(actual_departure_delay_min), 2) + 0.0 AS avg_dep_delay, "
    "round(avg(delay_change), 2) + 0.0 AS avg_delay_change, "
    "round(coalesce(avg(delay_change) FILTER (WHERE delay_change > 0), 0.0), 2) + 0.0 AS delay_amplification "
    "FROM transformed WHERE origin_station <> destination_station GROUP BY 1, 2), "
    "ew AS (SELECT *, abs(avg_arrival_delay) + 0.1 AS weight FROM e0), "
    "vx AS (SELECT origin_station AS node FROM e0 UNION SELECT destination_station FROM e0), "
    "deg AS (SELECT vx.node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree "
    "FROM vx LEFT JOIN (SELECT destination_station AS node, count(*) AS n FROM e0 GROUP BY 1) i USING (node) "
    "LEFT JOIN (SELECT origin_station AS node, count(*) AS n FROM e0 GROUP BY 1) o USING (node)) ")


def _pr_sql(rounds: int = PR_ROUNDS) -> str:
    parts = [", tp AS (SELECT origin_station AS s, destination_station AS t, weight / sum(weight) OVER (PARTITION BY origin_station) AS p FROM ew), "
             "nv AS (SELECT count(*) AS n FROM vx), "
             "vd AS (SELECT node, node NOT IN (SELECT s FROM tp) AS dangling FROM vx), "
             "pr0 AS (SELECT node, dangling, 1.0 / (SELECT n FROM nv) AS r FROM vd)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"prc{k} AS (SELECT t AS node, sum(r * p) AS c, max(dm) AS dm FROM (SELECT node, r, sum(CASE WHEN dangling THEN r ELSE 0.0 END) "
            f"OVER () AS dm FROM pr{k - 1}) q LEFT JOIN tp ON q.node = tp.s GROUP BY t), "
            f"pr{k} AS (SELECT vd.node, vd.dangling, 0.15 / (SELECT n FROM nv) + 0.85 * (coalesce(prc{k}.c, 0.0) + "
            f"max(prc{k}.dm) OVER () / (SELECT n FROM nv)) AS r FROM vd LEFT JOIN prc{k} USING (node))")
    return ", ".join(parts) + f", prf AS (SELECT node, r AS pagerank FROM pr{rounds}) "


def _edges(spark, sf):
    return G.with_weight(G.edges(transformed(spark, sf)))


@register("gr_edges", with_xform(_EDGES + "SELECT origin_station, destination_station, trip_count, avg_arrival_delay, avg_dep_delay, "
                                 "avg_delay_change, delay_amplification FROM e0"))
def gr_edges(spark, sf):
    return G.edges(transformed(spark, sf))


@register("gr_vertices", with_xform(_EDGES + "SELECT node FROM vx"))
def gr_vertices(spark, sf):
    return G.vertices(G.edges(transformed(spark, sf)), S, D)


@register("gr_edge_weight", with_xform(_EDGES + "SELECT origin_station, destination_station, round(weight, 6) + 0.0 AS weight FROM ew"))
def gr_edge_weight(spark, sf):
    return _edges(spark, sf).select(S, D, r_round(F.col("weight"), 6).alias("weight"))


@register("gr_degree", with_xform(_EDGES + "SELECT node, degree, in_degree, out_degree FROM deg"))
def gr_degree(spark, sf):
    return G.degree(G.edges(transformed(spark, sf)), S, D).select("node", "degree", "in_degree", "out_degree")


@register("gr_pagerank", with_xform(_EDGES + _pr_sql() + "SELECT node, round(pagerank, 6) + 0.0 AS pagerank FROM prf"))
def gr_pagerank(spark, sf):
    pr = G.pagerank(_edges(spark, sf), S, D, "weight")
    return pr.select("node", r_round(F.col("pagerank"), 6).alias("pagerank"))


def _sp_sql(undirected: bool, hops: int = 8, name: str = "dist") -> str:
    base = "SELECT origin_station AS a, destination_station AS b, weight AS w FROM ew"
    if undirected:
        base += " UNION ALL SELECT destination_station, origin_station, weight FROM ew"
    w, w0, d = f"{name}_w", f"{name}_w0", f"{name}_d"
    parts = [f", {w} AS (SELECT a, b, min(w) AS w FROM ({base}) GROUP BY a, b), "
             f"{w0} AS (SELECT a, b, w FROM {w} WHERE a <> b UNION ALL SELECT node, node, 0.0 FROM vx), "
             f"{d}1 AS (SELECT a AS s, b AS t, w AS d FROM {w} WHERE a <> b)"]
    for k in range(2, hops + 1):
        parts.append(f"{d}{k} AS (SELECT s, b AS t, min(d + w) AS d FROM {d}{k - 1} JOIN {w0} ON t = a WHERE s <> b GROUP BY s, b)")
    return ", ".join(parts) + f", {name} AS (SELECT * FROM {d}{hops}) "


def _bt_sql(hops: int = 8) -> str:
    """Betweenness ``bt`` from the directed distances ``ddist``: path counts forwards, dependencies back, arc by arc."""
    parts = [", dz AS MATERIALIZED (SELECT s, t, d FROM ddist UNION ALL SELECT node, node, 0.0 FROM vx)",
             "tight AS MATERIALIZED (SELECT x.s, x.t AS u, w.b AS v FROM dz x JOIN ddist_w w ON x.t = w.a JOIN dz y ON y.s = x.s AND y.t = w.b "
             "WHERE w.a <> w.b AND abs(x.d + w.w - y.d) < 1e-7)",
             "pn0 AS (SELECT node AS s, node AS v, CAST(1 AS DOUBLE) AS n FROM vx)"]
    for k in range(1, hops + 1):
        parts.append(f"pn{k} AS MATERIALIZED (SELECT g.s, g.v, sum(p.n) AS n FROM pn{k - 1} p JOIN tight g ON p.s = g.s AND p.v = g.u GROUP BY g.s, g.v)")
    parts += ["pn AS MATERIALIZED (SELECT s, v, sum(n) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM pn{k}" for k in range(hops + 1))
              + ") GROUP BY s, v)",
              "share AS MATERIALIZED (SELECT g.s, g.u, g.v, x.n / y.n AS q FROM tight g JOIN pn x ON x.s = g.s AND x.v = g.u "
              "JOIN pn y ON y.s = g.s AND y.v = g.v)",
              "pc0 AS (SELECT s, v, CAST(1 AS DOUBLE) AS c FROM pn)"]
    for k in range(1, hops + 1):
        parts.append(f"pc{k} AS MATERIALIZED (SELECT h.s, h.u AS v, sum(h.q * p.c) AS c FROM share h JOIN pc{k - 1} p ON p.s = h.s AND p.v = h.v GROUP BY h.s, h.u)")
    parts.append("bt AS (SELECT vx.node, coalesce(b.c, 0.0) / (SELECT CASE WHEN count(*) > 2 THEN (count(*) - 1) * (count(*) - 2) ELSE 1 END "
                 "FROM vx) AS betweenness FROM vx LEFT JOIN (SELECT v, sum(c) AS c FROM ("
                 + " UNION ALL ".join(f"SELECT * FROM pc{k}" for k in range(1, hops + 1)) + ") WHERE v <> s GROUP BY v) b ON b.v = vx.node)")
    return ", ".join(parts) + " "


_CLOSE = (", cls AS (SELECT vx.node, c.closeness FROM vx LEFT JOIN (SELECT s AS node, count(*) / sum(d) AS closeness FROM udist GROUP BY s) c "
          "USING (node)) ")


@register("gr_shortest_paths", with_xform(_EDGES + _sp_sql(False) + "SELECT s, t, round(d, 6) + 0.0 AS d FROM dist"))
def gr_shortest_paths(spark, sf):
    d = G.shortest_paths(_edges(spark, sf), S, D, "weight", undirected=False)
    return d.select("s", "t", r_round(F.col("d"), 6).alias("d"))


@register("gr_closeness", with_xform(_EDGES + _sp_sql(True, name="udist") + _CLOSE
                                     + "SELECT node, round(closeness, 6) + 0.0 AS closeness FROM cls"))
def gr_closeness(spark, sf):
    c = G.closeness(_edges(spark, sf), S, D, "weight")
    return c.select("node", r_round(F.col("closeness"), 6).alias("closeness"))


@register("gr_betweenness", with_xform(_EDGES + _sp_sql(False, name="ddist") + _bt_sql()
                                       + "SELECT node, round(betweenness, 6) + 0.0 AS betweenness FROM bt"))
def gr_betweenness(spark, sf):
    b = G.betweenness(_edges(spark, sf), S, D, "weight")
    return b.select("node", r_round(F.col("betweenness"), 6).alias("betweenness"))


def _node_metrics(spark, sf):
    e = _edges(spark, sf).checkpoint()
    m = (G.degree(e, S, D).join(G.pagerank(e, S, D, "weight"), "node").join(G.betweenness(e, S, D, "weight"), "node")
         .join(G.closeness(e, S, D, "weight"), "node"))
    return m.select(F.col("node").alias("Station"), F.col("degree").alias("Degree"), F.col("in_degree").alias("In_Degree"),
                    F.col("out_degree").alias("Out_Degree"), r_round(F.col("pagerank"), 6).alias("PageRank"),
                    r_round(F.col("betweenness"), 6).alias("Betweenness"), r_round(F.col("closeness"), 6).alias("Closeness"))


@register("gr_node_metrics", with_xform(
    _EDGES + _pr_sql() + _sp_sql(False, name="ddist") + _bt_sql() + _sp_sql(True, name="udist") + _CLOSE
    + "SELECT node AS Station, degree AS Degree, in_degree AS In_Degree, out_degree AS Out_Degree, round(pagerank, 6) + 0.0 AS PageRank, "
    "round(betweenness, 6) + 0.0 AS Betweenness, round(closeness, 6) + 0.0 AS Closeness "
    "FROM deg JOIN prf USING (node) JOIN bt USING (node) JOIN cls USING (node)"))
def gr_node_metrics(spark, sf):
    return _node_metrics(spark, sf).orderBy(F.desc("PageRank"), F.asc("Station"))


@register("topk_hubs", with_xform(_EDGES + _pr_sql() + "SELECT node AS Station, round(pagerank, 6) + 0.0 AS PageRank, "
                                  "CAST(row_number() OVER (ORDER BY round(pagerank, 6) DESC, node) AS INT) AS rank FROM prf "
                                  "ORDER BY rank LIMIT 10"))
def topk_hubs(spark, sf):
    """head(10) of the PageRank ordering (a deterministic tiebreak on name)."""
    pr = G.pagerank(_edges(spark, sf), S, D, "weight").select(
        F.col("node").alias("Station"), r_round(F.col("pagerank"), 6).alias("PageRank"))
    return W.first_rows(pr, [F.desc("PageRank"), F.asc("Station")], 10, "rank")


@register("gr_edge_index", with_xform(
    _EDGES + ", ids AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INT) AS id FROM vx) "
    "SELECT a.id AS source, b.id AS target, e0.trip_count AS value FROM e0 JOIN ids a ON e0.origin_station = a.node "
    "JOIN ids b ON e0.destination_station = b.node"))
def gr_edge_index(spark, sf):
    """0-based vertex ids (sorted names) and the edge list re-keyed to them."""
    e = G.edges(transformed(spark, sf))
    ids = W.running_totals(G.vertices(e, S, D), ["node"], [], rn="no").select("node", (F.col("no") - 1).cast("int").alias("id"))
    return (e.join(ids.select(F.col("node").alias(S), F.col("id").alias("source")), S)
            .join(ids.select(F.col("node").alias(D), F.col("id").alias("target")), D)
            .select("source", "target", F.col("trip_count").alias("value")))


@register("gr_hub_cluster", with_xform(
    _EDGES + _pr_sql() + ", hubs AS (SELECT node AS Station, round(pagerank, 6) + 0.0 AS PageRank FROM prf ORDER BY pagerank DESC, node LIMIT 10), "
    "lab AS (SELECT origin_station, CASE WHEN station_delay_rate > 30 AND route_avg_delay > 10 THEN 'Bottleneck-Prone' "
    "WHEN station_delay_rate > 30 THEN 'Delay-Sensitive' ELSE 'Stable' END AS cluster FROM transformed), "
    "sc AS (SELECT origin_station, cluster, count(*) AS n FROM lab GROUP BY 1, 2), "
    "dom AS (SELECT origin_station, cluster AS dominant_cluster FROM (SELECT *, rank() OVER (PARTITION BY origin_station ORDER BY n DESC) AS rk FROM sc) WHERE rk = 1) "
    "SELECT Station, PageRank, dominant_cluster FROM hubs LEFT JOIN dom ON hubs.Station = dom.origin_station"))
def gr_hub_cluster(spark, sf):
    """Top-10 hubs × the dominant (most frequent, ties kept) cluster label of
    their trips; left join with different key names."""
    from .q_cluster import threshold_label
    df = transformed(spark, sf)
    lab = df.select(S, threshold_label().alias("cluster"))
    counts = lab.groupBy(S, "cluster").agg(F.count("*").alias("n"))
    dom = W.top1_with_ties(counts, [S], "n").select(S, F.col("cluster").alias("dominant_cluster"))
    hubs = topk_hubs(spark, sf).select("Station", "PageRank")
    return hubs.join(dom, hubs.Station == dom[S], "left").select("Station", "PageRank", "dominant_cluster")


@register("gr_stop_propagation",
          "SELECT stop, next_stop, count(*) AS n, round(avg(next_delay - delay), 4) + 0.0 AS mean_increase FROM "
          "(SELECT event_type AS stop, value AS delay, lead(event_type) OVER w AS next_stop, lead(value) OVER w AS next_delay "
          "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_stop IS NOT NULL "
          "GROUP BY 1, 2 HAVING count(*) > 10")
def gr_stop_propagation(spark, sf):
    """Consecutive stops per vehicle → edges with mean delay increase, n > 10."""
    ev = table(spark, sf, "events")
    nxt = W.next_in_sequence(ev, "user_id", ["ts", "event_id"], "event_type", "value").where(F.col("next_event_type").isNotNull())
    g = nxt.groupBy(F.col("event_type").alias("stop"), F.col("next_event_type").alias("next_stop")).agg(
        F.count("*").alias("n"), r_round(F.avg(F.col("next_value") - F.col("value")), 4).alias("mean_increase"))
    return g.where(F.col("n") > 10)


@register("gr_propagation_rate",
          "SELECT stop, round(avg(next_delay - delay) / nullif(avg(lag_min), 0), 6) + 0.0 AS propagation_rate, count(*) AS n FROM "
          "(SELECT event_type AS stop, value AS delay, lead(value) OVER w AS next_delay, "
          "CAST(date_diff('microsecond', ts, lead(ts) OVER w) AS DOUBLE) / 60000000.0 AS lag_min "
          "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_delay IS NOT NULL GROUP BY stop")
def gr_propagation_rate(spark, sf):
    """Mean delay increase per minute of lag, per stop (ratio of aggregates)."""
    ev = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = ev.select(F.col("event_type").alias("stop"), F.col("value").alias("delay"), F.lead("value").over(w).alias("next_delay"),
                  ((F.unix_micros(F.to_timestamp(F.lead("ts").over(w))) - F.unix_micros(F.to_timestamp("ts"))) / 6e7).alias("lag_min"))
    g = x.where(F.col("next_delay").isNotNull()).groupBy("stop").agg(
        F.avg(F.col("next_delay") - F.col("delay")).alias("inc"), F.avg("lag_min").alias("lag"), F.count("*").alias("n"))
    return g.select("stop", r_round(F.when(F.col("lag") != 0, F.col("inc") / F.col("lag")), 6).alias("propagation_rate"), "n")

"""Pages and streams, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions import html
from ..operators import audit
from ..runtime import load
from ..sources import artifacts
from ..sources.bindings import EDGES_SQL, edges
from ..streaming import streams


def page_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Body text of every document that is a page: its hash, length, selector and flags."""
    p = load(spark, d, "documents").filter(x.content_type("text") == "text/html").select("doc_id", html.extract_body("text").alias("b"))
    return p.select("doc_id", "b.selector", F.sha2("b.text", 256).alias("body_sha256"), F.length("b.text").alias("n"), F.array_join("b.flags", ",").alias("flags"))


def text_variants(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of different hashes that a text has over its line-end and mark variants."""
    t = load(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.size(F.array_distinct(x.byte_variants("text"))).alias("variants"))


def url_instants(spark: SparkSession, d: str) -> DataFrame:
    """Publication times written into made-up addresses of each document's fetch time."""
    u = load(spark, d, "documents").filter("fetched_at is not null").select("doc_id", F.concat(F.lit("https://a.example/x-"), F.date_format("fetched_at", "yyyyMMddHHmmss"), F.lit("211.htm")).alias("url"))
    return u.select("doc_id", x.url_instant("url").cast("timestamp_ntz").alias("published"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = artifacts.materialize_graph(edges(spark, d))
    return nodes.withColumn("snapshot_ids", F.array_join("snapshot_ids", ","))


def graph_store_parity(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the store holds per snapshot against the ends of the edge rows as they were delivered, blank ones and nulls included."""
    nodes, _ = artifacts.materialize_graph(edges(spark, d))
    stored = nodes.select("entity_id", F.explode("snapshot_ids").alias("snapshot_id"))
    raw = load(spark, d, "snapshot_edges").select("snapshot_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    return audit.parity_by(stored, raw, "snapshot_id", "entity_id")


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour windows of all events, as a stream."""
    e = streams.read_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = streams.run_to_table(streams.window_counts(e, "at", "event_type", "value"), "windows", "complete")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user: those that the stream has closed, and those still open at its end."""
    at = lambda e: e.withColumn("at", F.col("ts").cast("timestamp"))
    closed = streams.run_to_table(streams.sessions(at(streams.read_table(spark, d, "events")), "user_id", "at", 6 * 3600), "sessions")
    return closed.unionByName(streams.open_sessions(at(load(spark, d, "events")), closed, "user_id", "at", 6 * 3600))


QUERIES = {f.__name__: f for f in (page_bodies, text_variants, url_instants, graph_nodes, graph_store_parity, stream_window_counts, stream_sessions)}

# page_bodies has none: parsing is compared with fixtures in the tests.
SQL = {
    "text_variants": r"""WITH t AS (SELECT doc_id, text, replace(text, chr(13) || chr(10), chr(10)) AS lf FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(list_distinct([sha256(text), sha256(lf), sha256(replace(lf, chr(10), chr(13) || chr(10))), sha256(chr(65279) || text), sha256(regexp_replace(text, '[\r\n]+$', ''))])) AS int) AS variants FROM t""",
    "url_instants": "SELECT doc_id, date_trunc('second', fetched_at) - INTERVAL 7 HOUR AS published FROM documents WHERE fetched_at IS NOT NULL",
    "graph_nodes": f"WITH {EDGES_SQL} SELECT entity_id, array_to_string(list_sort(list(DISTINCT snapshot_id)), ',') AS snapshot_ids, min(snapshot_id) AS first_seen FROM (SELECT snapshot_id, unnest([h, t]) AS entity_id FROM e) GROUP BY 1",
    "graph_store_parity": f"""WITH {EDGES_SQL}, u AS (SELECT snapshot_id AS s, unnest([h, t]) AS i, true AS l, false AS r FROM e UNION ALL SELECT snapshot_id, unnest([subject_id, object_id]), false, true FROM snapshot_edges), g AS (SELECT s, i, bool_or(l) AS l, bool_or(r) AS r FROM u GROUP BY s, i)
SELECT s AS snapshot_id, CASE WHEN NOT l THEN 'RIGHT_ONLY' WHEN NOT r THEN 'LEFT_ONLY' ELSE 'BOTH' END AS side, count(*) AS n FROM g GROUP BY ALL""",
    "stream_window_counts": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH l AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events),
s AS (SELECT *, count(*) FILTER (was IS NULL OR us - was > 21600000000) OVER (PARTITION BY user_id ORDER BY us) AS k FROM l) SELECT CAST(user_id AS varchar) AS key, min(us) AS started, max(us) AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
}

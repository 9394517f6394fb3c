"""Registered queries: an operator over a view, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The views of sources/views.py in SQL, in an order in which each uses only those before it.
VIEWS = {
    "samples": "SELECT user_id AS video, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, CASE WHEN event_type = 'error' THEN 'camera' ELSE 'screen' END AS call, value / 100 AS frac, event_id % 40 AS boxes, value AS level, event_type AS app FROM events",
    "cues": "SELECT user_id AS video, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, props AS text FROM events WHERE event_type = 'view'",
    "screens": "SELECT user_id AS video, CAST(floor(epoch(ts)) AS BIGINT) AS start, event_id AS seq FROM events WHERE event_type = 'click'",
    "chat": "SELECT conv_id AS video, turn * 10 AS ts, seq, role AS who, said, seq = 0 AS opens FROM (SELECT *, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM conversations) WHERE said <> ''",
    "lines": "SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents",
    "words": "SELECT doc, line, k, text, off * 10 AS x0, off * 10 + length(text) * 10 AS x1, line * 20 + (doc + line) % 3 AS y0, line * 20 + (doc + line) % 3 + 14 AS y1 FROM (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT doc, line, generate_subscripts(string_split(text, ' '), 1) - 1 AS k, unnest(string_split(text, ' ')) AS text FROM lines)) WHERE text <> ''",
    "two": "SELECT doc, line, text AS a, CASE (doc + line) % 5 WHEN 1 THEN replace(text, ' ', '') WHEN 2 THEN replace(text, 'l', '1') WHEN 3 THEN regexp_replace(text, ' [^ ]*$', '') WHEN 4 THEN replace(text, '.', ',') ELSE text END AS b FROM lines",
    "frows": "SELECT l_orderkey AS list, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS r, [l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INT) AS VARCHAR)] AS cells FROM lineitem",
    "rects": "SELECT l_orderkey AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS id, CASE WHEN l_returnflag = 'N' THEN 'window' ELSE 'pane' END AS kind, l_partkey * 37 % 1500 AS x0, l_suppkey * 53 % 800 AS y0, l_partkey * 37 % 1500 + 50 + 20 * CAST(l_quantity AS BIGINT) AS x1, l_suppkey * 53 % 800 + 40 + CAST(floor(l_extendedprice) AS BIGINT) % 400 AS y1 FROM lineitem",
    "segments": "SELECT l_orderkey AS frame, CASE WHEN l_linestatus = 'F' THEN 'h' ELSE 'v' END AS axis, l_partkey % 200 AS pos, l_suppkey * 7 % 500 AS a, l_suppkey * 7 % 500 + CAST(l_quantity AS BIGINT) AS b FROM lineitem",
    "thumbs": "SELECT vec_id AS frame, CAST(label AS BIGINT) AS burst, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS BIGINT)) AS thumb FROM embeddings",
    "names": "SELECT p_partkey AS key, p_name AS name, CASE p_partkey % 4 WHEN 1 THEN replace(p_name, 'o', '0') WHEN 2 THEN substr(p_name, 1, 4) || '…' || right(p_name, 4) WHEN 3 THEN upper(p_name) ELSE p_name END AS reading, CAST(p_size AS BIGINT) AS seen_at FROM part",
    "tree": "SELECT pos, name, depth, key, 181 + 38 * depth + key % 3 AS x0, pos * 40 AS y0, pos * 40 + 20 AS y1, key % 2 = 0 AS collapsed FROM (SELECT *, row_number() OVER (ORDER BY a, b, c) - 1 AS pos FROM (SELECT r_regionkey AS a, -1 AS b, -1 AS c, r_name AS name, 0 AS depth, CAST(r_regionkey AS BIGINT) AS key FROM region UNION ALL SELECT n_regionkey, n_nationkey, -1, n_name, 1, n_nationkey FROM nation UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, s_name, 2, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey))",
    "labelled": "SELECT d.doc_id AS item, quality AS want, n_chars // 40 AS boxes, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "runs": "SELECT o_orderkey AS run, o_custkey AS video, o_totalprice / 1000 AS took, o_totalprice AS size, o_orderstatus = 'F' AS done, o_orderpriority AS phase FROM orders",
    "records": "SELECT conv_id AS video, CASE role WHEN 'system' THEN 'header' WHEN 'user' THEN 'moment' ELSE 'footer' END AS kind, turn AS seq, text FROM conversations",
}
NEEDS = {"words": ["lines"], "two": ["lines"]}


def query(name: str, views: str = "", sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir). ``sql`` follows `WITH` and the named views: further tables, or a SELECT."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            used = [v for v in VIEWS if any(v == w or v in NEEDS.get(w, ()) for w in views.split())]
            with_ = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
            body = sql.strip()
            starts = body[:6].upper() == "SELECT"
            ORACLE[name] = (f"WITH {with_}" + ("\n" if starts else ",\n") if used else "" if starts else "WITH ") + body
        return f

    return keep

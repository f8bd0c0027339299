"""Where plans register their queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The canonical tables in SQL; a name may use those above it.
VIEWS = {
    "ev": "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events",
    "det": """SELECT event_id + 1 AS id, 1 + user_id % 3 AS project_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS seq,
      'src/m' || user_id || '.py' AS file_path, event_type AS define_name, k, CAST(k % 20 AS VARCHAR) AS node_fingerprint,
      CAST(k % 40 AS VARCHAR) AS fine_fingerprint, CAST(k AS VARCHAR) AS content_hash, ts AS created_at, user_id,
      CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'create' WHEN k >= 95 THEN 'delete' ELSE 'modify' END AS edit_type FROM ev""",
    "gd": "SELECT p_partkey // 2 AS f, p_partkey AS t FROM part WHERE p_partkey > 0 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 0",
    "forest": "SELECT a.p_partkey AS f, b.p_partkey AS t FROM part b JOIN part a ON a.p_partkey = b.p_partkey // 2 WHERE b.p_partkey > 0 AND a.p_brand = b.p_brand",
    "calls": "SELECT t AS caller, f AS callee FROM gd",
    "hub": "SELECT DISTINCT l_partkey AS caller, l_suppkey AS callee FROM lineitem",
    "cases": """SELECT o_orderkey AS run, 'tests.C' || o_custkey AS classname, o_orderpriority AS name,
      CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' ELSE 'skipped' END AS status FROM orders""",
    "sess": """SELECT project_id, 's-' || project_id || '-' || n AS session_id, n * 100 AS start_seq, CASE WHEN n * 100 + 100 < top THEN n * 100 + 100 END AS end_seq
      FROM (SELECT project_id, top, unnest(range(0, (top - 1) // 100 + 1)) AS n FROM (SELECT project_id, max(seq) AS top FROM det GROUP BY 1))""",
    "cov": """SELECT DISTINCT 1 + user_id % 3 AS project_id, 'src/m' || user_id || '.py' AS file_path, event_type AS define_name, 'tests.C' || o_custkey AS classname, o_orderpriority AS name
      FROM orders JOIN events ON o_custkey = user_id WHERE event_type IN ('purchase', 'view')""",
    "crash": "SELECT id, project_id, seq, CASE k % 3 WHEN 0 THEN 'TypeError|undefined' WHEN 1 THEN 'KeyError|missing' END AS sig FROM det WHERE define_name = 'error'",
    "chains": "SELECT project_id, file_path, define_name, max(seq) AS latest_seq, count(*) AS version_count, arg_max(id, seq) AS latest_id FROM det GROUP BY ALL",
    "inc": """SELECT event_id AS id, 1 + user_id % 3 AS project_id, CASE event_id % 3 WHEN 0 THEN 'stuck_region' WHEN 1 THEN 'debug_loop' ELSE 'define_loop' END AS signal,
      'src/m' || user_id || '.py::' || event_type AS target_node, CASE k // 10 % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'notified_agent' WHEN 2 THEN 'escalated_user' ELSE 'resolved' END AS state,
      epoch_us(ts) AS created_us, epoch_us(ts) + k * 60000000 AS updated_us FROM ev WHERE k % 10 = 0""",
    "anc": "SELECT t AS node, f AS a FROM gd UNION SELECT anc.node, gd.f FROM anc JOIN gd ON gd.t = anc.a",
}


def _with_views(sql: str) -> str:
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                need(body.replace(name, "") if name == "anc" else body)
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    if not wanted:
        return re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "WITH RECURSIVE ", sql, flags=re.I)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    if m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I):
        return f"WITH RECURSIVE {head}, {sql[m.end():]}"
    return f"WITH RECURSIVE {head} {sql}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL for DuckDB."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _with_views(sql)
        return f

    return put

"""Domain tables derived from the generic test tables, one SQL text for Spark and for the oracle."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from adlattice.session import size_shuffles

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()

VIEWS: dict[str, str] = {
    # lineitem repeats (order, line) pairs
    "fx_line": """
SELECT l_orderkey AS ok, l_linenumber AS ln, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk,
       CAST(MIN(l_quantity) AS INT) AS q, MIN(l_linestatus) AS ls, MIN(l_returnflag) AS rf, MIN(l_shipdate) AS sd
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "fx_spec": """
SELECT CONCAT('sp', CAST(p_partkey AS STRING)) AS slug, CAST(p_partkey AS INT) AS sort_order,
       CASE p_partkey % 6 WHEN 0 THEN 'google' WHEN 1 THEN 'meta' WHEN 2 THEN 'naver' WHEN 3 THEN 'kakao' WHEN 4 THEN 'linkedin' ELSE 'tiktok' END AS media,
       CASE p_partkey % 3 WHEN 0 THEN 'display' WHEN 1 THEN 'feed' ELSE 'native' END AS placement_type,
       CAST(120 + (p_partkey * 37) % 1801 AS INT) AS width, CAST(50 + (p_partkey * 53) % 1871 AS INT) AS height,
       p_partkey % 7 <> 0 AS active,
       CASE WHEN p_partkey % 5 = 0 THEN 'parsed_text' WHEN p_partkey % 5 = 1 THEN 'no_safezone' ELSE 'diagram_unreadable' END AS parse_status,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 41 AS INT) END AS safe_top,
       CASE WHEN p_partkey % 5 = 0 AND p_partkey % 35 <> 0 THEN CAST(p_partkey % 23 AS INT) END AS safe_right,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 31 AS INT) END AS safe_bottom,
       CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 19 AS INT) END AS safe_left
FROM {part}""",
    "fx_job": """
SELECT o_orderkey AS job_id, c_name AS advertiser, CONCAT('camp', CAST(o_custkey % 17 AS STRING)) AS campaign, o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'fail' WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'pending' END AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "fx_job_spec": "SELECT ok AS job_id, ln AS ordinal, CONCAT('sp', CAST(pk AS STRING)) AS slug FROM {fx_line}",
    "fx_result": """
SELECT ok AS job_id, ln AS ordinal, CONCAT('sp', CAST(pk AS STRING)) AS slug,
       CASE WHEN q % 11 = 0 THEN NULL ELSE q % 13 <> 0 END AS valid, q * 1000 AS file_size,
       CONCAT('f', CAST(ln AS STRING), '.png') AS file_name, CAST(sk % 101 AS INT) AS score, rf = 'R' AS applied
FROM {fx_line}""",
    "fx_image": """
SELECT o_orderkey AS image_id, CAST(600 + (o_orderkey * 7) % 1401 AS INT) AS width, CAST(400 + (o_orderkey * 11) % 1201 AS INT) AS height FROM {orders}""",
    "fx_object": """
SELECT ok AS image_id, ln AS ord,
       CASE pk % 8 WHEN 0 THEN 'product' WHEN 1 THEN 'logo' WHEN 2 THEN 'title_group' WHEN 3 THEN 'body_text_group' WHEN 4 THEN 'cta_group'
                   WHEN 5 THEN 'badge' WHEN 6 THEN 'decorative_ad' ELSE 'protected_subject' END AS role,
       ls = 'O' AS required, pk % 8 <> 7 OR q = 50 AS movable,
       CAST((pk * 13 + ln * 29) % 500 AS INT) AS x, CAST((pk * 17 + ln * 31) % 350 AS INT) AS y,
       CAST(20 + (q * 7) % 200 AS INT) AS w, CAST(20 + (q * 5 + sk) % 150 AS INT) AS h, q AS conf_pct
FROM {fx_line}""",
    "fx_det": """
SELECT image_id, ord AS det, CASE WHEN role IN ('product', 'logo') THEN role ELSE 'person' END AS role,
       x + ord % 5 AS x, y + ord % 7 AS y, w + ord AS w, h + ord AS h, (conf_pct * 2) % 101 AS quality FROM {fx_object}""",
    "fx_run": """
SELECT ok AS image_id, ln AS mask_id, CAST(q % 10 AS INT) AS y, CAST(pk % 60 AS INT) AS x0, CAST(pk % 60 + 1 + sk % 20 AS INT) AS x1 FROM {fx_line}""",
    "fx_event": """
SELECT event_id, ts, user_id AS job_id,
       CASE event_type WHEN 'signup' THEN 'job_start' WHEN 'view' THEN 'stage_start' WHEN 'click' THEN 'stage_pass' WHEN 'error' THEN 'stage_fail' ELSE 'job_pass' END AS event,
       CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'SOURCE_PREPARATION' WHEN 1 THEN 'SCENE_ANALYSIS' WHEN 2 THEN 'LAYOUT' ELSE 'FINAL_VALIDATION' END AS stage
FROM {events}""",
    "fx_layer": """
SELECT ok AS psd_id, ln AS ord, CAST(CASE WHEN ln = 1 THEN 0 ELSE pk % 3 END AS INT) AS depth,
       CASE pk % 9 WHEN 0 THEN '[title-group] a' WHEN 1 THEN 'product 1' WHEN 2 THEN 'Title' WHEN 3 THEN '[logo]' WHEN 4 THEN 'badge'
                   WHEN 5 THEN 'person' WHEN 6 THEN 'bg' WHEN 7 THEN 'body' ELSE 'misc' END AS name,
       q % 4 = 0 AS is_group, q % 9 <> 0 AS visible,
       CAST(pk % 300 AS INT) AS x1, CAST(sk % 200 + ln AS INT) AS y1, CAST(pk % 300 + 10 + q AS INT) AS x2, CAST(sk % 200 + ln + 10 + q AS INT) AS y2
FROM {fx_line}""",
    "fx_attempt": """
SELECT conv_id AS call_id, turn AS attempt,
       CASE LENGTH(text) % 5 WHEN 0 THEN 'unsupported_parameter' WHEN 1 THEN 'model_not_found' WHEN 2 THEN 'rate_limit' ELSE NULL END AS error_code,
       LENGTH(text) % 101 AS score
FROM {conversations}""",
}

_HOLE = re.compile(r"\{(\w+)\}")


class Tables:
    """Lazily loaded base tables and derived views of one folder: ``t.lineitem``, ``t.fx_object``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE:
                path = f"{self.folder}/{name}.parquet"
                size_shuffles(self.spark, path)
                frame = self.spark.read.parquet(path)
            else:
                text = VIEWS[name]
                frame = self.spark.sql(text, **{n: getattr(self, n) for n in set(_HOLE.findall(text))})
            self._seen[name] = frame
        return self._seen[name]


def with_views(sql: str) -> str:
    """Oracle text: the derived views that ``sql`` names become leading CTEs."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for dep in _HOLE.findall(VIEWS[name]):
            if dep in VIEWS:
                visit(dep)
        needed.append(name)

    for name in re.findall(r"\bfx_\w+", sql):
        if name in VIEWS:
            visit(name)
    ctes = [f"{n} AS ({_HOLE.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in needed]
    body = sql.strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", body, re.I))
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*ctes, body[own.end():]])
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body

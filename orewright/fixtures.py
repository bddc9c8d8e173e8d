"""Input views derived from the test tables, written once in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "assets": """
SELECT p_partkey AS id, p_partkey % 4 AS root_id,
       concat('f', cast(p_partkey % 7 AS varchar(9)), '/', replace(lower(p_name), ' ', '_'), '_', cast(p_partkey AS varchar(9)),
              CASE p_partkey % 4 WHEN 0 THEN '.stl' WHEN 1 THEN '.obj' WHEN 2 THEN '.3mf' ELSE '.glb' END) AS rel_path,
       p_name AS name,
       CASE p_partkey % 4 WHEN 0 THEN 'stl' WHEN 1 THEN 'obj' WHEN 2 THEN '3mf' ELSE 'glb' END AS format,
       cast(round(p_retailprice * 100) AS bigint) AS size_bytes,
       md5(concat(p_brand, p_type, cast(p_size AS varchar(9)))) AS sha256,
       12 * (1 + p_size % 10) AS triangles,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size * 1.0e0 + (p_partkey % 3) * 0.01e0 END AS bbox_x,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size * 2.0e0 END AS bbox_y,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size * 3.0e0 END AS bbox_z,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 6.0e0 * p_size * p_size * p_size * (1 + (p_partkey % 50) * 0.004e0) END AS volume_cm3,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_partkey % 7 <> 0 END AS watertight,
       p_brand AS collection, lower(p_type) AS tag1, lower(substring(p_name, 1, 3)) AS tag2,
       CASE WHEN p_partkey % 23 = 0 THEN 'error' WHEN p_partkey % 29 = 0 THEN 'skipped' ELSE 'ok' END AS status,
       900000000 + p_partkey * 86400 AS file_modified_at
FROM part""",
    "roots": """
SELECT cast(r_regionkey AS bigint) AS id, r_name AS name FROM region""",
    "listings": """
SELECT p_partkey AS model_id, concat('Listing ', p_name) AS title, concat(p_brand, ' ', p_type) AS description,
       CASE WHEN p_partkey % 6 = 0 THEN 'assistant' ELSE 'manual' END AS listing_source
FROM part WHERE p_partkey % 3 = 0""",
    "album_models": """
SELECT l_suppkey % 10 AS album_id, l_partkey AS model_id, min(l_orderkey) AS added_at FROM lineitem GROUP BY l_suppkey % 10, l_partkey""",
    "assets_v1": """
SELECT p_partkey AS id, concat('p', cast(p_partkey AS varchar(9))) AS rel_path, p_size AS size_bytes, 1000.0e0 + p_partkey AS mtime,
       md5(concat(p_name, 'v1')) AS sha256, CASE WHEN p_partkey % 31 = 0 THEN 'error' ELSE 'ok' END AS status
FROM part WHERE p_partkey % 11 <> 0""",
    "assets_v2": """
SELECT p_partkey AS id, concat('p', cast(p_partkey AS varchar(9))) AS rel_path,
       CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS size_bytes,
       CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN 2000.0e0 + p_partkey ELSE 1000.0e0 + p_partkey END AS mtime,
       CASE WHEN p_partkey % 13 = 0 THEN md5(concat(p_name, 'v2')) ELSE md5(concat(p_name, 'v1')) END AS sha256
FROM part WHERE p_partkey % 19 <> 0""",
    "geo_nodes": """
SELECT CAST(p_partkey AS INT) AS node, (p_partkey % 5) * 1000.0e0 AS x, floor(p_partkey / 5) * 1000.0e0 AS y FROM part""",
    "geo_lines": """
SELECT CAST(p_partkey AS INT) AS a, CAST(p_partkey + 1 AS INT) AS b, 20 + 10 * (p_partkey % 3) AS speed_kmh, p_partkey % 7 = 3 AS oneway, p_partkey % 25 = 12 AS bridge FROM part WHERE p_partkey % 5 < 4 AND p_partkey + 1 < (SELECT count(*) FROM part)
UNION ALL SELECT CAST(p_partkey AS INT), CAST(p_partkey + 5 AS INT), 20 + 10 * (p_partkey % 3), p_partkey % 7 = 3, p_partkey % 25 = 12 FROM part WHERE p_partkey + 5 < (SELECT count(*) FROM part)""",
    "geo_demand": """
SELECT id, (spot % 5) * 1000.0e0 + (id % 9 - 4) * 10 AS x, floor(spot / 5) * 1000.0e0 + (id % 7 - 3) * 10 AS y, weight
FROM (SELECT c_custkey AS id, c_custkey * 7 % (SELECT count(*) FROM part) AS spot, greatest(round(c_acctbal), 0.0e0) AS weight FROM customer) c""",
    "geo_candidates": """
SELECT id, (spot % 5) * 1000.0e0 + (id % 5) * 10 AS x, floor(spot / 5) * 1000.0e0 AS y, 1 + id % 3 AS cost FROM (SELECT s_suppkey AS id, s_suppkey * 19 % (SELECT count(*) FROM part) AS spot FROM supplier) s""",
    "cells": """
SELECT CAST(o_orderkey % 25 AS INT) AS row, CAST(floor(o_orderkey / 25) AS INT) AS col,
       CASE WHEN o_orderkey % 97 = 96 THEN NULL ELSE 2.0e0 * abs(25 - floor(o_orderkey / 25) % 50) + 0.5e0 * (o_orderkey % 25) + ((o_orderkey % 25 * 7 + floor(o_orderkey / 25) * 13) % 11) END AS z,
       CAST((o_orderkey % 25 * 3 + floor(o_orderkey / 25)) % 4 AS INT) AS class
FROM orders""",
    "parcels": """
SELECT p_partkey AS id, (p_partkey * 37 % 2200) + 2500.0e0 * floor(p_partkey / 200) AS x0, (p_partkey * 53 % 2200) * 1.0e0 AS y0,
       (p_partkey * 37 % 2200) + 2500.0e0 * floor(p_partkey / 200) + 20.0e0 + p_size * 5 AS x1, (p_partkey * 53 % 2200) + 20.0e0 + (p_partkey % 40) * 5 AS y1,
       CASE p_partkey % 4 WHEN 0 THEN 'industrial' WHEN 1 THEN 'logistics' WHEN 2 THEN 'rural' ELSE NULL END AS zoning
FROM part""",
    "restricted": """
SELECT s_suppkey AS id, (s_suppkey % 10) * 220.0e0 + 2500.0e0 * floor(s_suppkey / 100) AS x0, floor(s_suppkey % 100 / 10) * 220.0e0 AS y0, (s_suppkey % 10) * 220.0e0 + 2500.0e0 * floor(s_suppkey / 100) + 60 AS x1, floor(s_suppkey % 100 / 10) * 220.0e0 + 60 AS y1
FROM supplier""",
    "box_faces_seed": """
SELECT p_partkey AS model_id, p_size * 1.0e0 AS a, p_size * 2.0e0 AS b, p_size * 3.0e0 AS c FROM part""",
    "tx": """
SELECT o_custkey % 20 AS grp, o_custkey AS payer, (o_custkey + o_orderkey) % 100 AS payee, cast(round(o_totalprice * 100) AS bigint) AS cents FROM orders""",
    "receipts": """
SELECT o_orderkey AS doc_id,
       concat('Pedido n. ', cast(100000 + o_orderkey AS varchar(12)), '. Total: ', cast(cast(floor(o_totalprice) AS bigint) AS varchar(12)), ',50 EUR',
              '. Fecha de emision: ', substring(cast(o_orderdate AS varchar(30)), 1, 10)) AS text FROM orders""",
    "journal": """
SELECT event_id AS seq, concat('w', cast(event_id AS varchar(12))) AS id, ts, user_id AS session,
       CASE WHEN event_type = 'error' THEN 'undo' ELSE 'write' END AS kind, value > 5 AS ok,
       concat('o', cast(event_id % 50 AS varchar(9))) AS object,
       CASE WHEN event_type = 'error' THEN concat('w', cast(event_id - 3 AS varchar(12))) END AS undoes FROM events""",
    "messages": """
SELECT conv_id * 1000 + turn AS seq, conv_id AS session_id, role AS author_id,
       CASE WHEN turn % 3 = 2 THEN 'participant' ELSE 'room' END AS visibility,
       CASE WHEN turn % 6 = 5 THEN 'room' ELSE 'user' END AS audience1, text AS content FROM conversations""",
    "albums": """
SELECT r_regionkey * 2 AS id, concat(r_name, ' album') AS name FROM region""",
    "folder_listings": """
SELECT root_id, split_part(rel_path, '/', 1) AS folder, concat('Set ', min(collection), ' ', CASE WHEN count(*) % 5 = 0 THEN 'twin' ELSE split_part(rel_path, '/', 1) END) AS title,
       repeat(concat(min(tag1), ' '), CAST(5 + count(*) % 20 AS INT)) AS description,
       substring('t01|t02|t03|t04|t05|t06|t07|t08|t09|t10|t11|t12|t13|t14|t15|t16|t17|t18|t19|t20|t21|t22|t23|t24', 1, CAST(4 * (18 + (count(*) + root_id) % 5) - 1 AS INT)) AS tags,
       CASE (count(*) + root_id) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'draft' WHEN 2 THEN 'checked' ELSE 'approved' END AS status,
       max(file_modified_at) AS updated_at
FROM assets GROUP BY root_id, split_part(rel_path, '/', 1)""",
    "asset_paths": """
SELECT id, CASE WHEN id % 17 = 0 THEN concat('.git/', rel_path) WHEN id % 19 = 0 THEN concat('node_modules/x/', rel_path) WHEN id % 23 = 0 THEN upper(rel_path) ELSE rel_path END AS rel_path, size_bytes FROM assets""",
}


def needed(sql: str) -> list[str]:
    """The views that a statement names, each after those that it is made of."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def _counts(sql: str) -> str:
    """``count_if(x)`` as a plain count, which DuckDB gives as BIGINT."""
    while (a := sql.find("count_if(")) >= 0:
        depth, b = 1, a + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            b += 1
        sql = f"{sql[:a]}count(CASE WHEN {sql[a + len('count_if('):b - 1]} THEN 1 END){sql[b:]}"
    return sql


def oracle(sql: str) -> str:
    """``sql`` with the views that it names in front."""
    sql = _counts(sql)
    names = needed(sql)
    head = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    if not names:
        return sql
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {head},\n{body[14:].strip()}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {head},\n{body[4:].strip()}"
    return f"WITH {head}\n{body}"


class Inputs:
    """Tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        """A statement over tables and views of the folder."""
        text = oracle(sql).replace("{", "{{").replace("}", "}}")
        used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text, re.I)]
        for t in used:
            text = re.sub(rf"(\b(?:FROM|JOIN)\s+){t}\b", rf"\g<1>{{{t}}}", text, flags=re.I)
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

"""The snapshot database's tables, derived from the driver's tables.

Each is one SQL text of constructs that Spark and DuckDB read alike, so that a check derives the same input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "devices": (("supplier", "nation"), """
        SELECT 'r' || CAST(s_suppkey AS STRING) AS hostname, n_name AS site,
            CASE s_suppkey % 5 WHEN 0 THEN 'cisco-ios' WHEN 1 THEN 'JunOS' WHEN 2 THEN 'nx-os' WHEN 3 THEN 'arista' ELSE 'mikrotik-ros' END AS platform,
            CASE s_suppkey % 7 WHEN 0 THEN 'core' WHEN 1 THEN 'border' WHEN 2 THEN 'access' WHEN 3 THEN 'dist' WHEN 4 THEN 'wan' WHEN 5 THEN 'edge' ELSE NULL END AS role,
            CASE s_suppkey % 3 WHEN 0 THEN 'cisco' WHEN 1 THEN 'juniper' ELSE 'arista' END AS vendor,
            'M' || CAST(s_suppkey % 4 AS STRING) || '-' || CAST(s_suppkey % 11 AS STRING) AS model,
            '10.0.' || CAST(CAST(floor(s_suppkey / 256) AS INT) AS STRING) || '.' || CAST(s_suppkey % 256 AS STRING) AS ip_address
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "raw": (("orders",), """
        SELECT 'r' || CAST(o_custkey % 997 AS STRING) AS device_name,
            CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'show running-config' WHEN '2' THEN 'show version' WHEN '3' THEN 'show ip route' WHEN '4' THEN 'show interfaces' ELSE 'show ip bgp summary' END AS command,
            'snap_' || CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) || '01_000000_t' AS snapshot_id,
            CASE o_custkey % 4 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'juniper_junos' WHEN 2 THEN 'arista_eos' ELSE NULL END AS platform,
            o_orderkey AS seq, o_orderdate AS updated_at,
            CASE WHEN o_orderkey % 11 = 0 THEN '% Invalid input detected at marker for this long line' WHEN o_orderkey % 13 = 0 THEN 'short'
            ELSE 'hostname r' || CAST(o_custkey % 997 AS STRING) || chr(10) || 'router ospf ' || CAST(o_custkey % 5 AS STRING) || chr(10) || ' network 10.' || CAST(o_orderkey % 4 AS STRING) || '.0.0' || chr(10)
                || '!' || chr(10) || 'enable password 7 secret' || CAST(o_custkey % 17 AS STRING) || chr(10) || 'neighbor 10.0.0.' || CAST(o_custkey % 9 AS STRING) || ' route-map RM' || CAST(o_orderkey % 3 AS STRING) || ' in' || chr(10)
                || 'route-map RM' || CAST(o_orderkey % 3 AS STRING) || ' permit 10' || chr(10) || ' match community C' || CAST(o_orderkey % 4 AS STRING) || chr(10) || ' set metric ' || CAST(o_orderkey % 50 AS STRING) || chr(10)
                || 'route-map RM' || CAST(o_orderkey % 3 AS STRING) || ' deny 20' || chr(10) || '!' END AS raw_output
        FROM orders"""),
    "sessions": (("lineitem",), """
        SELECT 'r' || CAST(l_suppkey AS STRING) AS device_name, 'snap_' || CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING) || '01_000000_t' AS snapshot_id,
            '10.0.0.' || CAST(l_partkey % 250 AS STRING) AS neighbor, CAST(64512 + l_partkey % 100 AS STRING) AS remote_as,
            CASE l_linenumber % 7 WHEN 0 THEN 'Estab' WHEN 1 THEN 'FULL/DR' WHEN 2 THEN 'connected' WHEN 3 THEN 'administratively down' WHEN 4 THEN '12' WHEN 5 THEN 'Idle' ELSE 'weird one' END AS state,
            CASE WHEN l_linenumber % 2 = 0 THEN 'Gi0/' ELSE 'ge-0/0/' END || CAST(l_linenumber AS STRING) AS interface,
            l_orderkey AS ok, l_linenumber AS ln, l_shipdate AS seen
        FROM lineitem"""),
    "neighbors": (("lineitem",), """
        SELECT 'r' || CAST(a.l_suppkey AS STRING) AS device, 'Gi0/' || CAST(a.l_linenumber AS STRING) AS local_if,
            CASE b.l_linenumber % 3 WHEN 0 THEN 'R' || CAST(b.l_suppkey AS STRING) || '.example.net' WHEN 1 THEN 'r' || CAST(b.l_suppkey AS STRING) ELSE 'R' || CAST(b.l_suppkey AS STRING) || '-primary' END AS peer,
            'GigabitEthernet0/' || CAST(b.l_linenumber AS STRING) AS peer_if, 'cdp' AS protocol,
            'snap_' || CAST(year(a.l_shipdate) * 100 + month(a.l_shipdate) AS STRING) || '01_000000_t' AS snapshot_id
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_suppkey <> b.l_suppkey"""),
    "edges": (("lineitem",), """
        SELECT DISTINCT 'r' || CAST(least(a.l_suppkey, b.l_suppkey) AS STRING) AS src, 'r' || CAST(greatest(a.l_suppkey, b.l_suppkey) AS STRING) AS dst
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_suppkey <> b.l_suppkey"""),
    "logs": (("events",), """
        SELECT ts AS "timestamp", 'r' || CAST(user_id AS STRING) AS host,
            CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'NOTICE' WHEN 'signup' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'WARNING' END AS severity,
            event_type || ' ' || props AS message FROM events"""),
    "commands": (("part",), """
        SELECT CASE p_partkey % 4 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'juniper_junos' WHEN 2 THEN 'arista_eos' ELSE '*' END AS platform,
            CASE p_size % 5 WHEN 0 THEN 'show running-config' WHEN 1 THEN 'show version' WHEN 2 THEN 'show ip route' WHEN 3 THEN 'show interfaces' ELSE 'show ip bgp summary' END AS command,
            min(CASE p_partkey % 3 WHEN 0 THEN 'builtin' WHEN 1 THEN 'raw_only' ELSE 'learned' END) AS parser_type, min(p_partkey) % 6 = 0 AS blacklisted
        FROM part WHERE p_size % 5 <> 3 OR p_partkey % 4 = 1 GROUP BY 1, 2"""),
    "outputs": (("lineitem",), """
        SELECT 'r' || CAST(l_suppkey AS STRING) AS device_name,
            CASE l_linenumber % 5 WHEN 0 THEN 'show ip ospf neighbor' WHEN 1 THEN 'show ip bgp summary' WHEN 2 THEN 'show vlan' WHEN 3 THEN 'show ip interface brief' ELSE 'show interfaces terse' END AS command,
            'snap_' || CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING) || '01_000000_t' AS snapshot_id, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk,
            CASE WHEN l_partkey % 97 = 0 THEN 'no list' ELSE '[' || chr(123) || CASE l_linenumber % 5
                WHEN 0 THEN '"NEIGHBOR_ID": "10.0.0.' || CAST(l_partkey % 250 AS STRING) || '", "State": "' || CASE l_partkey % 4 WHEN 0 THEN 'FULL/DR' WHEN 1 THEN '2WAY' WHEN 2 THEN 'INIT' ELSE 'full' END || '", "address": "10.9.0.' || CAST(l_partkey % 200 AS STRING) || '", "interface": "Gi0/' || CAST(l_linenumber AS STRING) || '"'
                WHEN 1 THEN '"neighbor": "' || CASE WHEN l_partkey % 11 = 0 THEN '' ELSE '10.0.0.' || CAST(l_partkey % 250 AS STRING) END || '", "peer": "10.7.0.' || CAST(l_partkey % 9 AS STRING) || '", "as": "' || CAST(64512 + l_partkey % 100 AS STRING) || '", "state_pfxrcd": "' || CASE l_partkey % 3 WHEN 0 THEN '12' WHEN 1 THEN 'Idle' ELSE 'weird' END || '"'
                WHEN 2 THEN '"tag": "' || CAST(l_partkey % 30 AS STRING) || '", "interfaces": ["Gi0/' || CAST(l_partkey % 4 AS STRING) || '", "Gi0/' || CAST(l_partkey % 3 AS STRING) || '"]'
                WHEN 3 THEN '"interface": "Gi0/' || CAST(l_partkey % 40 AS STRING) || '", "ip_address": "' || CASE WHEN l_partkey % 3 = 0 THEN 'unassigned' ELSE '10.' || CAST(l_partkey % 99 AS STRING) || '.0.1' END || '", "status": "' || CASE WHEN l_partkey % 5 = 0 THEN 'down' ELSE 'up' END || '", "proto": "up"'
                ELSE '"interface": "ge-0/0/' || CAST(l_partkey % 40 AS STRING) || '", "ip_address": "' || CASE WHEN l_partkey % 4 = 0 THEN '' ELSE '10.' || CAST(l_partkey % 77 AS STRING) || '.1.1/24' END || '", "link_state": "up", "proto": "inet"'
            END || chr(125) || ']' END AS parsed_data
        FROM lineitem"""),
    "links": (("lineitem",), """
        SELECT 'r' || CAST(a.l_suppkey AS STRING) AS source_device, 'Gi0/' || CAST(a.l_linenumber AS STRING) AS source_interface, 'r' || CAST(b.l_suppkey AS STRING) AS destination_device,
            'Gi0/' || CAST(b.l_linenumber AS STRING) AS destination_interface, CASE a.l_partkey % 3 WHEN 0 THEN 'CDP' WHEN 1 THEN 'LLDP' ELSE 'FDP' END AS discovery_protocol,
            CASE WHEN a.l_partkey % 4 = 0 THEN NULL WHEN a.l_partkey % 4 = 1 THEN 'down' ELSE 'up' END AS link_status, 'snap_' || CAST(year(a.l_shipdate) AS STRING) || '0101_000000_t' AS snapshot_id
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_suppkey <> b.l_suppkey"""),
}
SQL = {k: (tables, " ".join(text.split())) for k, (tables, text) in SQL.items()}


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the snapshot database, derived by Spark."""
    tables, text = SQL[name]
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text.replace('"timestamp"', "`timestamp`"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def cte(*names: str) -> str:
    """The same tables for an oracle: WITH name AS (...)."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n][1].replace('AS STRING', 'AS VARCHAR')})" for n in names)

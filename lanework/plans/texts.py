"""Queries over texts that the given tables are turned into (JSON catalogs, header lines, key lines), and over the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.operators import changes, headers, json_catalog, manifests, ownership
from lanework.plans import carriers, catalog

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _json_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog per customer, its orders as records: as a bare list or under a name, with spellings that vary."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    record = F.expr(
        """'{"Name": "o' || o_orderkey || '", "ID": ' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', "Link": "https://cdn.test/' || o_orderkey || '.m3u8"' END
           || CASE WHEN o_orderkey % 3 = 0 THEN ', "group": ["x"]' ELSE ', "category": "G ' || o_orderstatus || '"' END || '}'"""
    )
    listed = orders.select("o_custkey", F.struct("o_orderkey", record.alias("r")).alias("x")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["r"]), ", "), F.lit("]"))
    kind = F.col("o_custkey") % 3
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit('{"data": 1, "Channels": '), body, F.lit("}"))).otherwise(F.concat(F.lit('{"channels": "none", "entries": '), body, F.lit("}")))
    return listed.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("url"), text.alias("text"))


@query(
    "explode_json_entries",
    """SELECT 'c' || o_custkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS entry_index, 'o' || o_orderkey AS name, o_orderkey::VARCHAR AS id,
              CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'https://cdn.test/' || o_orderkey || '.m3u8' END AS stream_url, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'G ' || o_orderstatus END AS group_title
       FROM orders""",
)
def explode_json_entries(spark, sf_dir):
    return json_catalog.explode_json_entries(_json_catalogs(spark, sf_dir))


@query(
    "merge_header_layers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'UA' || (l_suppkey % 7) AS user_agent, CASE WHEN l_partkey % 2 = 0 THEN 'j=' || l_partkey ELSE 'o=' || l_suppkey END AS cookie,
              CASE WHEN l_partkey % 3 = 0 THEN 'https://r.test/' || l_linenumber END AS referer
       FROM lineitem""",
)
def merge_header_layers(spark, sf_dir):
    lines = """array('#extvlcopt:http-user-agent=UA' || (l_suppkey % 7), '#EXTVLCOPT:http-cookie=o=' || l_suppkey,
                     CASE WHEN l_partkey % 3 = 0 THEN '#EXTVLCOPT:http-extra-headers=referer: https://r.test/' || l_linenumber ELSE '#EXTVLCOPT:other=1' END,
                     CASE WHEN l_partkey % 2 = 0 THEN '#EXTHTTP:{"COOKIE": "j=' || l_partkey || '", "user_agent": ""}' ELSE '#EXTHTTP:{' END)"""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(lines).alias("lines"))
    rows = rows.withColumn("h", headers.merge_header_layers(headers.option_headers(F.col("lines")), headers.json_headers(F.col("lines"))))
    value = lambda k: F.try_element_at("h", F.lit(k))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value("User-Agent").alias("user_agent"), value("Cookie").alias("cookie"), value("Referer").alias("referer"))


@query("encryption_flags", "SELECT 'm' || o_orderkey AS manifest_url, o_custkey % 5 IN (2, 3, 4) AS protected, o_custkey % 5 IN (3, 4) AS key_required FROM orders")
def encryption_flags(spark, sf_dir):
    line = """CASE o_custkey % 5 WHEN 0 THEN '#EXT-X-KEY:METHOD=NONE' WHEN 1 THEN '#EXT-X-KEY:URI="k"' WHEN 2 THEN '#EXT-X-KEY:METHOD=AES-128,URI="https://k.test/' || o_orderkey || '"'
                   WHEN 3 THEN '#EXT-X-SESSION-KEY:METHOD=SAMPLE-AES,URI="k"' ELSE '  #EXT-X-KEY:METHOD=AES-128,URI="k",KEYFORMAT="com.x"' END"""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("manifest_url"), F.concat(F.lit("#EXTM3U\r\n"), F.expr(line), F.lit("\r\nseg.ts\n")).alias("text"))
    return manifests.encryption_flags(rows)


@query(
    "session_rollover",
    f"""WITH {catalog._DECIDED}, z AS (SELECT session_id, identity_key, arg_max(new_state, seq) AS state FROM d WHERE reason = '' GROUP BY ALL),
             a AS (SELECT session_id, count(*) FILTER (state NOT IN ('ENDED', 'MANUALLY_STOPPED', 'CRASHED')) AS active FROM z GROUP BY 1)
        SELECT s.session_id, CASE WHEN active > 0 THEN 'CONTINUED' WHEN active = 0 THEN 'ROLLED_OVER' ELSE 'CREATED' END AS action FROM (SELECT DISTINCT session_id FROM v) s LEFT JOIN a USING (session_id)""",
)
def session_rollover(spark, sf_dir):
    return ownership.session_rollover(carriers.events(spark, sf_dir))


_CHANGES = " UNION ALL ".join(f"SELECT n, marker FROM ({catalog.ORACLES[name]})" for name in ("diff_identities", "diff_sources", "diff_quality"))


@query("scan_history", f"SELECT n, marker, count(*) AS changes FROM ({_CHANGES}) GROUP BY ALL")
def scan_history(spark, sf_dir):
    return changes.scan_history(catalog.keyed(spark, sf_dir))

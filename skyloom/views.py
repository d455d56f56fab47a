"""Tables of this domain derived from the given TPC-H-like tables, written once in SQL that Spark and DuckDB share up to a few functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECT = {
    "spark": {"us": "unix_micros(CAST({} AS TIMESTAMP))", "k": "CAST(get_json_object(props, '$.k') AS INT)", "at": 0, "div": "div", "pixels": "SELECT vec_id, label AS role, e, p FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, e"},
    "duckdb": {"us": "epoch_us({})", "k": "CAST(json_extract_string(props, '$.k') AS INTEGER)", "at": 1, "div": "//", "pixels": "SELECT vec_id, label AS role, unnest(embedding) AS e, unnest(range(64)) AS p FROM embeddings"},
}
#: For each view the tables it reads and its text.
TABLES = {"v_pose": ("events",), "v_dirs": ("embeddings",), "v_pixels": ("embeddings",), "v_blobs": ("lineitem", "orders"), "v_stars": ("part",), "v_sites": ("supplier",), "v_fixes": ("events",), "v_segments": ("orders",), "v_optics": ("part",), "v_sensors": ("supplier",)}


def text(view: str, engine: str) -> str:
    d = DIALECT[engine]
    us, k, at = d["us"].format, d["k"], d["at"]
    return {
        "v_pose": f"SELECT user_id AS session, event_id AS seq, event_type AS kind, {us('ts')} AS t_us, {k} AS k, radians({k}*36e-1) AS az, radians((CAST(round(value*100) AS BIGINT) % 9000)/1e2) AS alt FROM events",
        "v_dirs": f"SELECT id, cls, x/n AS x, y/n AS y, z/n AS z FROM (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM (SELECT vec_id AS id, label AS cls, CAST(embedding[{at}] AS DOUBLE) AS x, CAST(embedding[{at + 1}] AS DOUBLE) AS y, CAST(embedding[{at + 2}] AS DOUBLE) AS z FROM embeddings) a) b",
        "v_pixels": f"SELECT role, row_number() OVER (PARTITION BY role, p ORDER BY vec_id)-1 AS idx, p {d['div']} 8 AS y, p % 8 AS x, CAST(floor(abs(CAST(e AS DOUBLE))*65535) AS BIGINT) AS v FROM ({d['pixels']}) q",
        "v_blobs": f"SELECT o.o_custkey AS session, l.l_orderkey AS frame, {us('o.o_orderdate')} AS t_us, l.l_linenumber AS blob, l.l_partkey AS k1, l.l_suppkey AS k2, (CAST(round(l.l_extendedprice*100) AS BIGINT) % 384000)/1e2 AS px, CAST((l.l_partkey*7919) % 2160 AS DOUBLE) AS py, l.l_quantity AS peak, l.l_discount*10 AS roundness, 1+l.l_tax*100 AS size_px FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey",
        "v_stars": "SELECT p_partkey AS hip, p_name AS name, p_size/1e1 AS mag, ((CAST(p_partkey AS BIGINT)*13750776) % 36000000)/1e5 AS ra_deg, (((CAST(p_partkey AS BIGINT)*7919) % 18001)-9000)/1e2 AS dec_deg FROM part",
        "v_sites": "SELECT s_suppkey AS site, ((CAST(s_suppkey AS BIGINT)*7919) % 13001)/1e2-65 AS lat_deg, ((CAST(s_suppkey AS BIGINT)*104729) % 36000)/1e2-180 AS lon_deg, abs(s_acctbal)/10 AS h_m FROM supplier",
        "v_fixes": f"SELECT user_id AS url, event_id AS seq, {us('ts')} AS t_us, ({k}-50)*13e-1 AS lat_deg, (CAST(round(value*100) AS BIGINT) % 36000)/1e2-180 AS lon_deg, value*20 AS h_m FROM events",
        "v_segments": f"SELECT o_custkey AS session, 'r' || CAST(o_orderkey % 3 AS STRING) AS role, o_orderkey AS segment, {us('o_orderdate')} AS t_us, o_orderstatus = 'F' AS important, CAST(floor(o_totalprice) AS BIGINT) % 50 AS n_lines, CAST(floor(o_totalprice / 7) AS BIGINT) % 50 AS n_disk FROM orders",
        "v_sensors": f"SELECT s_suppkey AS sensor, s_suppkey {d['div']} 2 AS rig, 1000 + s_suppkey % 7 * 400 AS res_x, 800 + s_suppkey % 5 * 300 AS res_y, 2 + s_suppkey % 9 / 2e0 AS pixel_um FROM supplier",
        "v_optics": f"SELECT p_partkey AS optic, p_partkey {d['div']} 40 AS rig, 8 + p_size * 50e0 AS focal_mm, 10 + p_size * 5e0 AS aperture_mm FROM part",
    }[view]


def view(spark: SparkSession, sf_dir: str, name: str, placed: str | None = None) -> DataFrame:
    """The view as a DataFrame over the tables in sf_dir; ``placed`` names a table that the view selects from directly: ``place``, a number, then tells where a row stands in its files."""
    sql = text(name, "spark")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    if placed:
        rows = frames[placed].select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        files = sorted(r.file for r in rows.select("file").distinct().collect())
        order = spark.createDataFrame(list(enumerate(files)), "n long, file string")  # a number, since paths beside each row fill the disk
        frames[placed] = rows.join(F.broadcast(order), "file").withColumn("place", F.shiftleft("n", 40) + F.col("row"))
        sql = sql.replace("SELECT ", "SELECT place, ", 1)
    for t in frames:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(sql, **frames)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names put before it."""
    used = [v for v in TABLES if v in sql]
    head = ", ".join(f"{v} AS ({text(v, 'duckdb')})" for v in used)
    sql, start = sql.lstrip(), "WITH RECURSIVE " if sql.lstrip().startswith("WITH RECURSIVE ") else "WITH "
    return f"{start}{head}{', ' if sql.startswith(start) else ' '}{sql.removeprefix(start)}" if used else sql

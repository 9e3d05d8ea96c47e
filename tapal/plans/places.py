"""Registered queries over map files: places and streets of PBF files that are written from the tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.operators import evaluation as E
from tapal.plans import inputs as I
from tapal.plans.registry import query
from tapal.sources import osm_pbf as O
from tapal.sources.documents import shared_folder

_SUPPLIERS = """
SELECT cast(s_suppkey AS bigint) AS id, -6000000 - 400000 * cast(s_suppkey % 9 AS int) - cast(s_suppkey % 997 AS int) AS lat, 106000000 + 300000 * cast(s_suppkey * 7 % 11 AS int) AS lon, s_name AS name,
 CASE s_suppkey % 4 WHEN 0 THEN 'school' WHEN 1 THEN 'mosque' ELSE '' END AS amenity, CASE WHEN s_suppkey % 4 = 2 THEN 'village' ELSE '' END AS place, CASE WHEN s_suppkey % 3 = 0 THEN 'Jalan ' || s_name ELSE '' END AS street
FROM {supplier}"""
_ORDERS = """
SELECT cast(o_orderkey AS bigint) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'Jalan é' ELSE '' END AS highway, CASE WHEN o_orderkey % 2 = 0 THEN 'Jalan ' || cast(o_custkey AS string) ELSE '' END AS name FROM {orders}"""
_n, _w = I.oracle_table(_SUPPLIERS), I.oracle_table(_ORDERS)


def _tags(**columns: str) -> F.Column:
    """The tags that have a value."""
    every = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k.replace("_", ":")), F.col(v))])
    return F.map_filter(every, lambda _, v: v != "")


def _files(spark, sf_dir: str) -> str:
    """Suppliers as nodes and orders as ways over their lines' suppliers, in PBF files."""
    path = f"{shared_folder(spark)}/osm-{uuid.uuid4().hex}"
    nodes = I.spark_table(spark, sf_dir, _SUPPLIERS)
    O.write(nodes.select("id", (F.col("lat") / 1e6).alias("lat"), (F.col("lon") / 1e6).alias("lon"), _tags(name="name", amenity="amenity", place="place", addr_street="street").alias("tags")), path, "nodes")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("id"), F.struct("l_linenumber", F.col("l_suppkey").cast("long").alias("node")).alias("at"))
    own = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["node"]).alias("node_ids"))
    O.write(I.spark_table(spark, sf_dir, _ORDERS).join(own, "id").select("id", "node_ids", _tags(highway="highway", name="name").alias("tags")), path, "ways")
    return path


@query("osm_landmarks", f"""SELECT id, lat AS lat_e6, lon AS lon_e6, name, CASE WHEN amenity <> '' THEN amenity WHEN place <> '' THEN place END AS category, CASE WHEN street <> '' THEN street END AS street
 FROM {_n} n WHERE lat BETWEEN -9000000 AND -7000000 AND lon BETWEEN 106500000 AND 108500000 AND (amenity <> '' OR place <> '' OR street <> '')""")
def _(spark, sf_dir):
    found = O.landmarks(O.read(spark, _files(spark, sf_dir), "nodes"), -9.0000000001, -6.9999999999, 106.4999999999, 108.5000000001)
    return found.select("id", F.round(F.col("lat") * 1e6).cast("int").alias("lat_e6"), F.round(F.col("lon") * 1e6).cast("int").alias("lon_e6"), "name", "category", F.col("address")["addr:street"].alias("street"))


@query("osm_street_places", f"""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS node FROM lineitem), f AS (SELECT id, min(line * 100000000 + node) % 100000000 AS first_node, count(*) AS n_nodes FROM l GROUP BY id)
 SELECT w.id AS way_id, CASE WHEN w.name <> '' THEN w.name END AS name, w.highway, f.n_nodes, n.lat AS lat_e6, n.lon AS lon_e6 FROM {_w} w JOIN f ON f.id = w.id JOIN {_n} n ON n.id = f.first_node WHERE w.highway <> ''""")
def _(spark, sf_dir):
    path = _files(spark, sf_dir)
    ways, nodes = O.streets(O.read(spark, path, "ways")), O.read(spark, path, "nodes").select(F.col("id").alias("node_id"), "lat", "lon")
    e6 = lambda c: F.round(F.col(c) * 1e6).cast("int").alias(f"{c}_e6")
    return E.way_points(ways, nodes).join(ways, "way_id").select("way_id", "name", "highway", F.size("node_ids").cast("long").alias("n_nodes"), e6("lat"), e6("lon"))

"""Road network files: a text format, JSON, OpenStreetMap XML, drawings, and Parquet.

Text, JSON and drawings are small single files whose line order matters: they are read as
one row and split in the engine.  OpenStreetMap files go through the XML scan, which
splits; Parquet is the format for networks of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, to_utm, utm_zone

#: Road classes that are kept, and their layer.
LAYERS = {
    "motorway": 0, "motorway_link": 0, "trunk": 0, "trunk_link": 0, "primary": 1, "primary_link": 1,
    "secondary": 2, "secondary_link": 2, "tertiary": 3, "tertiary_link": 3, "unclassified": 4, "residential": 4,
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a small text file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def write_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([("\n".join(lines) + "\n",)], "value string").coalesce(1).write.text(path)


def _words(lines: DataFrame) -> DataFrame:
    return lines.select("n", "line", F.split(F.btrim("line"), r"\s+").alias("w"))


def _word(k: int, kind: str) -> Column:
    return F.get("w", F.lit(k)).cast(kind)


def with_length(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    a = vertices.select(F.col("v").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = vertices.select(F.col("v").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = edges.join(a, "src").join(b, "dst")
    return d.select("e", "src", "dst", distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("length"))


def read_maptxt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of ``[MapTxt] / V E / [Edges] / src dst ... / [Locations] / x y ...``."""
    lines = _words(numbered_lines(spark, path))
    at = {r.line.strip(): r.n for r in lines.where("line LIKE '[%'").collect()}
    first = lines.where(F.col("n") == at["[MapTxt]"] + 1).first()
    nv, ne = int(first.w[0]), int(first.w[1])
    e0, v0 = at["[Edges]"] + 1, at["[Locations]"] + 1
    edges = lines.where(F.col("n").between(e0, e0 + ne - 1)).select((F.col("n") - e0).cast("long").alias("e"), _word(0, "long").alias("src"), _word(1, "long").alias("dst"))
    vertices = lines.where(F.col("n").between(v0, v0 + nv - 1)).select((F.col("n") - v0).cast("long").alias("v"), _word(0, "double").alias("x"), _word(1, "double").alias("y"))
    return vertices, with_length(vertices, edges)


def write_maptxt(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    v, e = vertices.orderBy("v").collect(), edges.orderBy("e").collect()  # a text map is one small file
    lines = ["[MapTxt]", f"{len(v)} {len(e)}", "[Edges]", *(f"{r.src} {r.dst}" for r in e), "[Locations]", *(f"{r.x!r} {r.y!r}" for r in v)]
    write_text(vertices.sparkSession, path, lines)


JSON_MAP = "vertices array<struct<id:long,x:double,y:double>>, edges array<struct<id:long,src:long,sink:long>>"


def read_mapjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", JSON_MAP).alias("m"))
    vertices = d.select(F.explode("m.vertices").alias("r")).select(F.col("r.id").alias("v"), "r.x", "r.y")
    edges = d.select(F.explode("m.edges").alias("r")).select(F.col("r.id").alias("e"), "r.src", F.col("r.sink").alias("dst"))
    return vertices, with_length(vertices, edges)


def write_mapjson(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    v = vertices.agg(F.array_sort(F.collect_list(F.struct(F.col("v").alias("id"), "x", "y"))).alias("vertices"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("e").alias("id"), "src", F.col("dst").alias("sink")))).alias("edges"))
    v.join(e).select(F.to_json(F.struct("vertices", "edges")).alias("value")).coalesce(1).write.text(path)


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def write_parquet(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def read_osm(spark: SparkSession, path: str, zone: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices with osm_node, edges with layer and osm_way) of an OpenStreetMap file, in UTM metres.

    Ways of the known road classes are kept unless they are buildings or areas; a way gives
    an edge for each step, and one back unless it is one-way.  Ids are dense, by node id
    and by (way, place, direction).  Without ``zone`` the zone of the mean longitude is used.
    """
    tag = "tag array<struct<_k:string,_v:string>>"
    ways = spark.read.format("xml").options(rowTag="way").schema(f"_id long, nd array<struct<_ref:long>>, {tag}").load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))
    layer = F.element_at(F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv)), F.col("tags")["highway"])
    ways = ways.withColumn("tags", tags).withColumn("layer", layer).where("layer IS NOT NULL")
    ways = ways.where("coalesce(tags['building'], 'no') <> 'yes' AND coalesce(tags['area'], 'no') <> 'yes'")
    steps = ways.select(F.col("_id").alias("way"), "layer", (F.coalesce(F.col("tags")["oneway"], F.lit("no")) == "yes").alias("oneway"), "nd")
    steps = steps.select("way", "layer", "oneway", F.posexplode(F.transform("nd", lambda r: r["_ref"])).alias("pos", "a"), "nd")
    steps = steps.withColumn("b", F.get("nd", F.col("pos") + 1)["_ref"]).where("b IS NOT NULL AND a <> b").drop("nd")
    nodes = spark.read.format("xml").options(rowTag="node").schema("_id long, _lat double, _lon double").load(path)
    nodes = nodes.select(F.col("_id").alias("osm_node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    used = steps.select(F.explode(F.array("a", "b")).alias("osm_node")).distinct()
    nodes = nodes.join(used, "osm_node")
    if zone is None:
        lon = nodes.agg(F.avg("lon")).first()[0]
        zone = spark.range(1).select(utm_zone(F.lit(lon if lon is not None else 0.0))).first()[0]
    east, north = to_utm(F.col("lon"), F.col("lat"), F.lit(zone))
    number = (F.row_number().over(Window.orderBy("osm_node")) - 1).cast("long")  # dense ids need one order
    vertices = nodes.select(number.alias("v"), east.alias("x"), north.alias("y"), "osm_node")
    both = F.when(F.col("oneway"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    steps = steps.withColumn("back", F.explode(both))
    v = vertices.select("v", "osm_node")
    src = F.when(F.col("back") == 0, F.col("a")).otherwise(F.col("b"))
    dst = F.when(F.col("back") == 0, F.col("b")).otherwise(F.col("a"))
    steps = steps.withColumns({"na": src, "nb": dst})
    steps = steps.join(v.select(F.col("osm_node").alias("na"), F.col("v").alias("src")), "na").join(v.select(F.col("osm_node").alias("nb"), F.col("v").alias("dst")), "nb")
    e = (F.row_number().over(Window.orderBy("way", "pos", "back")) - 1).cast("long")
    edges = steps.select(e.alias("e"), "src", "dst", "layer", F.col("way").alias("osm_way"))
    return vertices, with_length(vertices, edges).join(edges.select("e", "layer", "osm_way"), "e")


NUMBER = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def read_drawing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a drawing: marks are vertices, path objects edges between the nearest marks.

    A path with an arrow is one-way.  Coordinates are those of the drawing.
    """
    use = spark.read.format("xml").options(rowTag="use").schema("_pos string, _name string").load(path).where("_name LIKE 'mark%'")
    number = (F.row_number().over(Window.orderBy("x", "y")) - 1).cast("long")
    xy = F.split(F.btrim("_pos"), r"\s+")
    vertices = use.select(F.get(xy, F.lit(0)).cast("double").alias("x"), F.get(xy, F.lit(1)).cast("double").alias("y"))
    vertices = vertices.select(number.alias("v"), "x", "y")
    lines = spark.read.format("xml").options(rowTag="path").schema("_VALUE string, _arrow string, _layer string").load(path)
    spots = F.regexp_extract_all("_VALUE", F.lit(rf"({NUMBER})\s+({NUMBER})\s+[ml]"), F.lit(0))
    lines = lines.withColumn("id", F.monotonically_increasing_id()).select("id", F.col("_arrow").isNotNull().alias("oneway"), F.posexplode(spots).alias("pos", "spot"))
    s = F.split("spot", r"\s+")
    lines = lines.select("id", "oneway", "pos", F.get(s, F.lit(0)).cast("double").alias("px"), F.get(s, F.lit(1)).cast("double").alias("py"))
    near = lines.join(F.broadcast(vertices)).groupBy("id", "oneway", "pos").agg(  # marks of one hand-made drawing
        F.min_by("v", F.struct(distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")), "v")).alias("src")
    )
    step = near.withColumn("dst", F.lead("src").over(Window.partitionBy("id").orderBy("pos"))).where("dst IS NOT NULL AND src <> dst")
    pair = F.when(F.col("oneway"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    edges = step.select(F.explode(pair).alias("k")).select("k.src", "k.dst").distinct()
    e = (F.row_number().over(Window.orderBy("src", "dst")) - 1).cast("long")
    return vertices, with_length(vertices, edges.select(e.alias("e"), "src", "dst"))

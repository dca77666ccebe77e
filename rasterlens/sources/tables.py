"""Inputs of the catalogue: surrogate objects, pixels, files, endpoints and schedules on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Categories as annotators spell them.
CATEGORIES = ["Silver box", "The avoided_area", " clean  area ", "SCRATCH", "pit", "Stain"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation object a (order, line): category and box on a 64 x 64 canvas."""
    rows = read(spark, sf_dir, "lineitem")
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    one = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    return one.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("pos"),
        F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("l_partkey") % 6).cast("int")).alias("category"),
        F.col("l_quantity").cast("int").alias("x0"),
        (F.col("l_partkey") % 50).cast("int").alias("y0"),
        (1 + F.col("l_suppkey") % 12).cast("int").alias("w"),
        (1 + F.col("l_linenumber")).cast("int").alias("h"),
        F.col("l_tax").alias("tax"),
        F.col("l_discount").alias("discount"),
    )


def raster_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterlens.operators.rasters import pixels

    return pixels(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("lang") == "en", ".png").when(F.col("lang") == "fr", ".JPG").when(F.col("lang") == "de", ".bmp").otherwise(".webp")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder"), F.concat(F.lit("IMG_"), F.col("doc_id")).alias("stem"), suffix.alias("suffix"), F.col("n_chars").alias("mtime"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a = F.radians(((k * 37) % 180).cast("double"))
    return read(spark, sf_dir, "part").select(k.alias("id"), (k % 5).alias("image_id"), F.floor(k / 2).alias("component_id"), (k % 977).alias("x"), ((k * 31) % 883).alias("y"), F.cos(a).alias("tx"), F.sin(a).alias("ty"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of schedule sheets, one sheet for each month of orders."""
    w = Window.partitionBy("sheet").orderBy("o_orderkey", "o_custkey", "o_totalprice")
    return read(spark, sf_dir, "orders").withColumn("sheet", F.date_format("o_orderdate", "yyyy-MM")).select(
        "sheet",
        F.row_number().over(w).alias("row"),
        F.when(F.col("o_orderpriority").startswith("4"), F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("a"),
        F.concat(F.month("o_orderdate"), F.lit("."), F.dayofmonth("o_orderdate")).alias("b"),
        F.when(F.col("o_orderstatus") == "P", F.lit("  ")).when(F.col("o_orderstatus") != "O", F.lit("done")).alias("d"),
        F.when(F.col("o_custkey") % 2 == 0, 255).alias("d_fill"),
    )


#: The same inputs for DuckDB.
SQL = {
    "O": """o AS (SELECT l_orderkey AS image_id, l_linenumber AS pos,
  ['Silver box','The avoided_area',' clean  area ','SCRATCH','pit','Stain'][CAST(l_partkey % 6 AS INT) + 1] AS category,
  CAST(l_quantity AS INT) AS x0, CAST(l_partkey % 50 AS INT) AS y0, CAST(1 + l_suppkey % 12 AS INT) AS w, CAST(1 + l_linenumber AS INT) AS h, l_tax AS tax, l_discount AS discount
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1)""",
    "P": """p AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) r(i))""",
    "F": """f AS (SELECT doc_id, source AS folder, 'IMG_' || doc_id AS stem, CASE lang WHEN 'en' THEN '.png' WHEN 'fr' THEN '.JPG' WHEN 'de' THEN '.bmp' ELSE '.webp' END AS suffix, n_chars AS mtime FROM documents)""",
    "E": """e AS (SELECT p_partkey AS id, p_partkey % 5 AS image_id, p_partkey // 2 AS component_id, p_partkey % 977 AS x, (p_partkey * 31) % 883 AS y,
  cos(radians((p_partkey * 37) % 180)) AS tx, sin(radians((p_partkey * 37) % 180)) AS ty FROM part)""",
    "T": """t AS (SELECT strftime(o_orderdate, '%Y-%m') AS sheet, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey, o_custkey, o_totalprice) AS row, CASE WHEN o_orderpriority LIKE '4%' THEN '  ' ELSE o_orderpriority END AS a,
  month(o_orderdate) || '.' || day(o_orderdate) AS b, CASE WHEN o_orderstatus = 'P' THEN '  ' WHEN o_orderstatus <> 'O' THEN 'done' END AS d, CASE WHEN o_custkey % 2 = 0 THEN 255 END AS d_fill FROM orders)""",
    "N": """n AS (SELECT *, array_to_string(list_filter(string_split(replace(lower(trim(category)), ' ', '_'), '_'), lambda q: q <> ''), '_') AS norm FROM o)""",
}

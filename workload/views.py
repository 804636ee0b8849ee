"""Views that give the test tables the shapes the library works on, in Spark
and, under the same name, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coratings import latest_ratings
from coratings.functions.clock import stamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(lines: DataFrame, user: str, *more: Column) -> DataFrame:
    # Order, line and quantity in one number: lines are below 8 and quantities
    # below 64, and the rating follows from the quantity, so it is a total
    # order of the ratings of a (user, movie).
    position = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("bigint")
    return lines.select(
        F.col(user).alias("user_id"),
        F.col("l_partkey").alias("movie_id"),
        (F.ceil(F.col("l_quantity") / 5) / 2).cast("double").alias("rating"),
        position.alias("position"),
        *more,
    )


def _rated(lines: DataFrame, user: str) -> DataFrame:
    return latest_ratings(_raw(lines, user), "position", total_order=True)


def positioned(lines: DataFrame, user: str, date: str) -> DataFrame:
    """All ratings with their positions and ``part``, a year of ``date`` from
    which on they belong to one part."""
    year = F.year(date)
    part = F.when(year >= 1998, 1998).when(year >= 1995, 1995).when(year >= 1993, 1993).otherwise(0)
    return _raw(lines, user, part.alias("part"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users: few users with many ratings each."""
    return _rated(table(spark, sf_dir, "lineitem"), "l_suppkey")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users: many users with few ratings each."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    return _rated(lines.join(orders, lines.l_orderkey == orders.o_orderkey), "o_custkey")


def popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users; two ratings in three go to the same 49 movies."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    common = F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(49))
    part = F.when(F.col("l_linenumber") % 3 != 0, common).otherwise(F.col("l_partkey") + 49)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return _rated(joined.withColumn("l_partkey", part.cast("bigint")), "o_custkey")


def offgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users; the last five digits of prices, with two decimals, as ratings."""
    cents = F.round(F.col("l_extendedprice").cast("double") * 100).cast("bigint") % 100_000
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("movie_id"),
        (cents / 100).alias("rating"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
    )
    return latest_ratings(raw, ["l_orderkey", "l_linenumber", "l_quantity"])


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as movies; brand and type as genres."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movie_id"),
        F.col("p_name").alias("title"),
        F.concat_ws("|", "p_brand", "p_type").alias("genres"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings, named after the order date."""
    key = F.col("o_orderkey")
    fps = (
        F.when(key % 4 == 0, F.lit(24.0))
        .when(key % 4 == 1, F.lit(25.0))
        .when(key % 4 == 2, F.lit(29.97))
        .otherwise(F.lit(30.0))
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("video_id"),
        F.concat(F.lit("/v/"), stamp(F.col("o_orderdate")), F.lit(".mkv")).alias("path"),
        fps.alias("fps"),
        (1000 + key % 500).alias("total_frames"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, part names and customer names, with the group they come from."""
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("name"), F.col("lang").alias("grp"))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("part").alias("grp"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("grp"))
    return texts.unionByName(parts).unionByName(customers)


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with the next one, and with itself."""
    key = F.col("s_suppkey")
    other = F.explode(F.array(key, key + 1))
    return table(spark, sf_dir, "supplier").select(key.alias("user_a"), other.alias("user_b"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating asked for by every customer."""
    movie = (F.col("c_nationkey") * 4 + 1).cast("bigint")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), movie.alias("movie_id")
    )


_RATED = """
  SELECT {user} AS user_id, l_partkey AS movie_id,
         ceil(max({{'o': l_orderkey, 'l': l_linenumber, 'q': l_quantity}}).q / 5) / 2 AS rating
  FROM {source} GROUP BY 1, 2"""

DENSE = _RATED.format(user="l_suppkey", source="lineitem")
SPARSE = _RATED.format(
    user="o_custkey", source="lineitem JOIN orders ON l_orderkey = o_orderkey"
)
OFFGRID = """
  SELECT l_suppkey AS user_id, l_partkey AS movie_id,
         max({'o': l_orderkey, 'l': l_linenumber, 'q': l_quantity,
              'c': round(l_extendedprice::DOUBLE * 100)::BIGINT % 100000}).c AS rating
  FROM lineitem GROUP BY 1, 2"""
POPULAR = _RATED.format(
    user="o_custkey",
    source="""(SELECT * REPLACE ((CASE WHEN l_linenumber % 3 <> 0 THEN (l_partkey * 7 + l_linenumber) % 49
      ELSE l_partkey + 49 END)::BIGINT AS l_partkey) FROM lineitem) AS li JOIN orders ON l_orderkey = o_orderkey""",
)
MOVIES = """
  SELECT p_partkey AS movie_id, p_name AS title, p_brand || '|' || p_type AS genres FROM part"""
# Fixed value: the form of the names of recordings.
VIDEOS = """
  SELECT o_orderkey AS video_id,
         '/v/' || strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') || '.mkv' AS path,
         CASE o_orderkey % 4 WHEN 0 THEN 24.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE
                             WHEN 2 THEN 29.97::DOUBLE ELSE 30.0::DOUBLE END AS fps,
         1000 + o_orderkey % 500 AS total_frames, o_orderdate AS start_time
  FROM orders"""
NAMES = """
  SELECT text AS name, lang AS grp FROM documents
  UNION ALL SELECT p_name, 'part' FROM part
  UNION ALL SELECT c_name, 'customer' FROM customer"""
SUPPLIER_PAIRS = """
  SELECT s_suppkey AS user_a, s_suppkey AS user_b FROM supplier
  UNION ALL SELECT s_suppkey, s_suppkey + 1 FROM supplier"""
REQUESTS = """
  SELECT c_custkey AS user_id, (c_nationkey * 4 + 1)::BIGINT AS movie_id FROM customer"""

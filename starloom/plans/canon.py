"""The canon's relations as views of the given tables, so that every operator runs on them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import dealt

LINES_A_PART = 500_000  # lines that one task sorts or adds up at once


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def artist_rows(t: Tables) -> DataFrame:
    years = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.year("o_orderdate")).alias("begin_year"), F.max(F.year("o_orderdate")).alias("end_year"))
    rows = t.customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("m"), "c_custkey").alias("mbid"), F.col("c_name").alias("name"), F.lower("c_name").alias("sort_name"),
        F.col("c_mktsegment").alias("kind_id"), F.col("c_nationkey").alias("area_id"), (F.col("c_acctbal") < 0).alias("ended"), F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("comment"),
    )
    return rows.join(years, "id", "left")


def parts(t: Tables) -> int:
    """Parts in which queries over all lines are worked on: as many more as there are more lines. Counting them reads no
    more than the files' footers."""
    return max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES_A_PART))


def kinds(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_mktsegment").alias("id"), F.initcap("c_mktsegment").alias("name")).distinct()


def areas(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def area_codes(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("name"))


def artists(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def credits(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("artist_id"))


def releases(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("release"), F.col("l_orderkey").alias("group"))


def dates(t: Tables) -> list[DataFrame]:
    dated = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("release"), F.year("l_shipdate").alias("year"), "l_linestatus")
    return [dated.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("F", "O")]


def groups(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("g"), "o_orderkey").alias("mbid"), F.concat(F.lit("order "), "o_orderkey").alias("name"), F.col("o_orderkey").alias("credit"), F.col("o_orderpriority").alias("kind_id"))


def group_kinds(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("id"), F.substring("o_orderpriority", 3, 20).alias("name")).distinct()


def relations(t: Tables) -> DataFrame:
    """First lines of orders that follow each other on a part; of an order's several ones that of the least discount comes
    first, so that the rows don't depend on how the table lies."""
    after = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_discount")
    rows = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id_0"), F.lead("l_orderkey").over(after).alias("id_1"), F.col("l_discount"), F.lead("l_discount").over(after).alias("d"))
    return rows.where("id_1 is not null").select("id_0", "id_1", (F.least("l_discount", "d") * 10).cast("float").alias("score"))


def supplier_pairs(t: Tables) -> DataFrame:
    """Suppliers of neighbouring lines of an order."""
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    rows = t.lineitem.select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(after).alias("b"))
    return rows.where("b is not null").withColumn("score", F.lit(1.0))


def masters(t: Tables) -> DataFrame:
    """An order is a master of its customer; its parts' types are genres, their brands styles."""
    n = parts(t)
    lines = dealt(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type", "p_brand"), n, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list("p_type").alias("genres"), F.collect_list("p_brand").alias("styles"))
    return dealt(t.orders.select("o_orderkey", "o_custkey"), n, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.array("o_custkey").alias("artists"), "genres", "styles")


def label_rows(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("profile"), F.col("p_size").cast("bigint").alias("parent_id"))


def entity_lines(t: Tables) -> DataFrame:
    """An event as an entity in JSON: its user's id, where it was formed (purchases, clicks) or born, and more."""
    k = F.get_json_object("props", "$.k")
    place = F.when(F.col("event_type").isin("purchase", "click"), "P740").otherwise("P19")
    line = F.format_string(
        '{"id":"Q%s","labels":{"en":{"value":"%s %s"}},"sitelinks":{"enwiki":{"title":"User %s"}},"claims":{"P434":[{"mainsnak":{"datavalue":{"value":"m%s"}}}],"%s":[{"mainsnak":{"datavalue":{"value":{"id":"Q%s"}}}}],'
        '"P571":[{"mainsnak":{"datavalue":{"value":{"time":"+%s-01-01T00:00:00Z"}}}}],"P136":[{"mainsnak":{"datavalue":{"value":{"id":"Q%s"}}}},{"mainsnak":{}}]}},',
        F.col("event_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("user_id").cast("string"), place, k, F.year("ts").cast("string"), k,
    )
    return t.events.select(line.alias("value"))


def users(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("id"), F.concat(F.lit("m"), "user_id").alias("mbid")).distinct()


def positions(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("artist_id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


def weights(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("artist_id"), (F.col("label") + 1).cast("double").alias("weight"))

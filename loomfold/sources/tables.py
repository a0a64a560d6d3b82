"""Typed readers and writers, and the roles (products, users, interactions, ...) of the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfold.functions import values as V

PRODUCTS = "id string, gender string, masterCategory string, subCategory string, articleType string, baseColour string, season string, year int, usage string, productDisplayName string, images string"
USERS = "id string, name string, email string, age int, gender string, interaction_history string"
INTERACTIONS = "user_id string, product_id string, interaction_type string, timestamp string"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
HISTORY = "array<struct<product_id:string,interaction_type:string,timestamp:string>>"


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV file with header under a declared schema; malformed cells become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Interactions with trimmed string ids; a timestamp that can't be read is null."""
    rows = read_csv(spark, path, INTERACTIONS)
    return rows.select(F.trim("user_id").alias("user_id"), F.trim("product_id").alias("product_id"), "interaction_type", F.try_to_timestamp("timestamp").alias("ts"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users with their history parsed from JSON."""
    return read_csv(spark, path, USERS).withColumn("parsed_interactions", F.from_json("interaction_history", HISTORY))


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls as empty cells, arrays, structs and maps as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def lines_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cells of a CSV file as they stand: blank ones are empty strings."""
    return read_csv(spark, path, schema).na.fill("")


def export_products(df: DataFrame, path: str) -> None:
    """Nulls as blank cells, images as JSON."""
    write_csv(df, path)


def export_users(users: DataFrame, interactions: DataFrame, path: str) -> None:
    """Users with their history as JSON, oldest first (ties by product, then type); timestamps in ISO form."""
    item = F.struct("product_id", "interaction_type", F.date_format("ts", ISO).alias("timestamp"))
    ordered = F.sort_array(F.collect_list(F.struct("ts", item.alias("item"))))
    history = interactions.groupBy("user_id").agg(F.transform(ordered, lambda x: x["item"]).alias("interaction_history"))
    none = F.array().cast(HISTORY)
    write_csv(users.join(history, "user_id", "left").withColumn("interaction_history", F.coalesce("interaction_history", none)), path)


def export_interactions(interactions: DataFrame, users: DataFrame, path: str) -> int:
    """Interactions of known users by time, in files of which each follows the one before; gives how many were rejected."""
    keep = interactions.join(users.select("user_id").distinct(), "user_id", "left_semi")
    cells = ["user_id", "product_id", "interaction_type", F.date_format("ts", ISO).alias("timestamp")]
    write_csv(keep.repartitionByRange("ts").sortWithinPartitions("ts", "user_id", "product_id", "interaction_type").select(*cells), path)
    return interactions.join(users.select("user_id").distinct(), "user_id", "left_anti").count()


def latest_pairs(interactions: DataFrame, n: int) -> DataFrame:
    """user_id, current_product_id, timestamp of the n latest interactions."""
    best = interactions.orderBy(F.desc("ts"), "user_id", "product_id").limit(n)
    return best.select("user_id", F.col("product_id").alias("current_product_id"), F.date_format("ts", ISO).alias("timestamp"))


SYNCED = ("gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage", "productDisplayName")


def sync_products(old: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog after a sync from CSV cells (all strings, with a column `line` of their order), and
    one row of counts: total, created, updated, skipped, errors.

    Cells are trimmed and blank ones null; a row without a whole number as id is skipped; a year that
    is no whole number is null. Of rows with one id the last counts, the first of them deciding between
    created and updated. A created product is named by its display name (else `Product <id>`) and has
    the slug `product-<id>`; an updated one keeps its name and slug. For a dry run take the counts
    only. Nothing here can fail for a row, so errors is 0. old: id bigint, name, slug and SYNCED."""
    clean = cells.select("line", *[F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")).alias(c) for c in ("id", *SYNCED)])
    whole = F.when(F.col("id").rlike(r"^[+-]?[0-9]+$"), F.col("id").try_cast("bigint"))
    rows = clean.withColumn("id", whole).withColumn("year", F.when(F.col("year").rlike(r"^[+-]?[0-9]+$"), F.col("year").try_cast("int")))
    last = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*SYNCED), F.col("line")).alias("row"))
    both = old.select("id", F.lit(True).alias("there"), F.struct("name", "slug", *SYNCED).alias("was")).join(last, "id", "full")
    fresh = F.col("there").isNull()
    name = F.when(fresh, F.coalesce("row.productDisplayName", F.concat(F.lit("Product "), F.col("id").cast("string")))).otherwise(F.col("was.name"))
    slug = F.when(fresh, F.concat(F.lit("product-"), F.col("id").cast("string"))).otherwise(F.col("was.slug"))
    merged = both.select("id", name.alias("name"), slug.alias("slug"), *[F.when(F.col("n").isNotNull(), F.col(f"row.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in SYNCED])
    made = F.coalesce(F.sum(F.when(fresh, 1)), F.lit(0))
    counts = both.where("n is not null").agg(made.alias("created"), (F.coalesce(F.sum("n"), F.lit(0)) - made).alias("updated"))
    seen = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("id").isNull()).alias("skipped"))
    return merged, seen.join(counts).select("total", "created", "updated", "skipped", F.lit(0).cast("long").alias("errors"))  # one row each


def read_first(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first parquet artifact that is there, else None."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(path)
    return None


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; the rest stays."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: Column, at: int) -> Column:
    out = None
    for k, said in V.ARTICLES.items():
        out = F.when(key == k, said[at]) if out is None else out.when(key == k, said[at])
    return out


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    gender = F.element_at(F.array(*[F.lit(g) for g in ("Men", "Women", "Boys", "Girls", "Unisex")]), (size % 5 + 1).cast("int"))
    usage = F.when(k % 7 == 0, None).otherwise(F.element_at(F.array(F.lit("Casual"), F.lit("Sports"), F.lit("Formal"), F.lit("Kid Party")), (k % 4 + 1).cast("int")))
    return part.select(
        k.cast("string").alias("product_id"), F.col("p_name").alias("name"), _case(F.col("p_type"), 0).alias("article_type"), _case(F.col("p_type"), 1).alias("sub_category"),
        _case(F.col("p_type"), 2).alias("master_category"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("base_colour"), gender.alias("gender"), usage.alias("usage"),
        (2010 + size % 10).cast("int").alias("year"), F.col("p_retailprice").alias("price"), ((k * 7 % 51) / 10.0).alias("rating"), (k * 13 % 40).alias("num_reviews"), (k % 6).alias("sale"), (k * 31 % 1000).alias("created_day"), F.col("p_brand").alias("brand"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    gender = F.when(c % 17 == 0, None).otherwise(F.element_at(F.array(F.lit("male"), F.lit("female"), F.lit("other")), (c % 3 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select(c.cast("string").alias("user_id"), F.col("c_name").alias("name"), (11 + c % 60).cast("int").alias("age"), gender.alias("gender"), F.col("c_mktsegment").alias("segment"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    kind = F.when(F.col("l_returnflag") == "R", "view").when(F.col("l_returnflag") == "A", "like").otherwise("purchase")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("product_id"), kind.alias("interaction_type"), F.col("o_orderdate").alias("ts"), "l_orderkey", "l_linenumber")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event interactions, with types that no weight scheme knows."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("product_id"), F.col("event_type").alias("interaction_type"), "ts", "value")


def _case_sql(at: int) -> str:
    return "case p_type " + " ".join(f"when '{k}' then '{v[at]}'" for k, v in V.ARTICLES.items()) + " end"


#: The same roles as common table expressions for the oracle.
ROLES_SQL = f"""
products as (select cast(p_partkey as varchar) as product_id, p_name as name, {_case_sql(0)} as article_type, {_case_sql(1)} as sub_category, {_case_sql(2)} as master_category,
  split_part(p_name, ' ', 1) as base_colour, list_extract(['Men','Women','Boys','Girls','Unisex'], p_size % 5 + 1) as gender,
  case when p_partkey % 7 = 0 then null else list_extract(['Casual','Sports','Formal','Kid Party'], p_partkey % 4 + 1) end as usage,
  cast(2010 + p_size % 10 as integer) as year, p_retailprice as price, (p_partkey * 7 % 51) / 10.0::double as rating, p_partkey * 13 % 40 as num_reviews, p_partkey % 6 as sale, p_partkey * 31 % 1000 as created_day, p_brand as brand from part),
users as (select cast(c_custkey as varchar) as user_id, c_name as name, cast(11 + c_custkey % 60 as integer) as age,
  case when c_custkey % 17 = 0 then null else list_extract(['male','female','other'], c_custkey % 3 + 1) end as gender, c_mktsegment as segment from customer),
interactions as (select cast(o_custkey as varchar) as user_id, cast(l_partkey as varchar) as product_id,
  case l_returnflag when 'R' then 'view' when 'A' then 'like' else 'purchase' end as interaction_type, o_orderdate as ts, l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey),
event_rows as (select event_id, cast(user_id as varchar) as user_id, json_extract_string(props, '$.k') as product_id, event_type as interaction_type, ts, value from events),
weighted as (select *, case interaction_type when 'purchase' then 5.0 when 'like' then 3.0 when 'cart' then 2.0 else 1.0 end::double as w from interactions)
"""

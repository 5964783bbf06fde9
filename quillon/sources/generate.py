"""A table of orders for benchmarks, made from row numbers and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The domains of the columns.
STATUSES = ("pending", "processing", "completed", "cancelled", "refunded")
COUNTRIES = ("UK", "US", "DE", "FR", "ES", "IT", "NL", "CA", "AU", "SE")
USERS, PRODUCTS, SECONDS_OF_YEAR = 200_000, 20_000, 31_536_000


def orders(spark: SparkSession, rows: int, seed: int = 42, in_time: bool = False) -> DataFrame:
    """Same rows for the same seed, however many tasks make them."""

    def pick(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))

    def one_of(values: tuple[str, ...], salt: str) -> Column:
        return F.array(*map(F.lit, values))[pick(len(values), salt).cast("int")]

    quantity, price = pick(5, "quantity") + 1, pick(9000, "price") + 1000
    discount = F.when(pick(100, "discounted") < 85, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(seed), F.lit("discount")), F.floor(price / 5) + 1))
    second = F.col("id") if in_time else F.floor(pick(SECONDS_OF_YEAR, "time") / 3600) * 3600
    made = spark.range(rows).select("id", quantity.alias("quantity"), price.alias("price_minor"), discount.cast("long").alias("discount_minor"), second.alias("second"))
    return made.select(
        F.format_string("ORD%09d", F.col("id") + 1).alias("order_id"),
        F.format_string("USR%06d", pick(USERS, "user") + 1).alias("user_id"),
        F.format_string("PRD%05d", pick(PRODUCTS, "product") + 1).alias("product_id"),
        "quantity", "price_minor", "discount_minor",
        F.greatest(F.col("price_minor") * F.col("quantity") - F.col("discount_minor"), F.lit(0)).alias("total_minor"),
        one_of(STATUSES, "status").alias("status"), one_of(COUNTRIES, "country").alias("country"),
        F.date_format(F.timestamp_seconds(F.lit(1_672_531_200) + F.col("second")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )

"""Generated sales, customer and product tables of any size, made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabularies, ranges and weights of the generated tables.
PRODUCTS = ("Widget A", "Widget B", "Widget C", "Gadget X", "Gadget Y")
CATEGORIES = ("Electronics", "Office", "Home", "Industrial")
REGIONS = ("North", "South", "East", "West")
SEGMENTS = ("Consumer", "Corporate", "SMB", "Enterprise")
TIERS = (("Bronze", 0.45), ("Silver", 0.35), ("Gold", 0.15), ("Platinum", 0.05))
TAX_RATES = ((0.0, 0.2), (0.05, 0.3), (0.12, 0.3), (0.18, 0.2))
PRODUCT_MASTER = (
    ("Widget A", "Electronics", 45.0, "Acme"),
    ("Widget B", "Electronics", 55.0, "Acme"),
    ("Widget C", "Office", 35.0, "Globex"),
    ("Gadget X", "Industrial", 120.0, "Initech"),
    ("Gadget Y", "Home", 85.0, "Umbrella"),
)


class _Dice:
    """Pseudo-random columns that depend on the row's id only, so retries repeat them."""

    def __init__(self, seed: int):
        self.seed, self.drawn = seed, 0

    def unit(self) -> Column:
        self.drawn += 1
        bits = F.pmod(F.xxhash64("id", F.lit(self.seed), F.lit(self.drawn)), F.lit(1 << 52))
        return bits / F.lit(float(1 << 52))

    def integer(self, low: int, high: int) -> Column:
        """Uniform in ``low .. high`` inclusive."""
        return (F.floor(self.unit() * (high - low + 1)) + low).cast("bigint")

    def between(self, low: float, high: float) -> Column:
        return self.unit() * (high - low) + low

    def choice(self, options) -> Column:
        return F.get(F.array(*[F.lit(o) for o in options]), self.integer(0, len(options) - 1))

    def weighted(self, options) -> Column:
        draw, reached, out = self.unit(), 0.0, F
        for value, weight in options[:-1]:
            reached += weight
            out = out.when(draw < reached, F.lit(value))
        return out.otherwise(F.lit(options[-1][0]))

    def day(self, first: str, days: int) -> Column:
        start = F.lit(first).cast("date")
        return F.date_add(start, self.integer(0, days - 1).cast("int")).cast("string")


def _customer_id(number: Column) -> Column:
    return F.concat(F.lit("CUST"), _padded(number, 5))


def _padded(number: Column, digits: int) -> Column:
    """At least ``digits`` digits; longer numbers are not cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def synthetic_sales(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    dice = _Dice(seed)
    cents = lambda col: F.round(col, 2)
    base = spark.range(1, rows + 1).select(
        F.concat(F.lit("ORD"), _padded(F.col("id"), 8)).alias("Order ID"),
        dice.day("2023-01-01", 1096).alias("Date"),
        _customer_id(dice.integer(1, 3999)).alias("Customer ID"),
        dice.choice(PRODUCTS).alias("Product"),
        dice.choice(CATEGORIES).alias("Category"),
        dice.choice(REGIONS).alias("Region"),
        dice.integer(1, 19).alias("Quantity"),
        cents(dice.between(5.0, 500.0)).alias("Unit Price"),
        dice.between(0.0, 0.1).alias("discount_rate"),
        dice.weighted(TAX_RATES).alias("tax_rate"),
        dice.between(0.55, 0.8).alias("cogs_rate"),
        dice.between(0.02, 0.08).alias("expense_rate"),
    )
    gross = F.col("Quantity") * F.col("Unit Price")
    return (
        base.withColumn("Discount", cents(gross * F.col("discount_rate")))
        .withColumn("Tax", cents((gross - F.col("Discount")) * F.col("tax_rate")))
        .withColumn("Revenue", cents(gross - F.col("Discount") + F.col("Tax")))
        .withColumn("COGS", cents(F.col("Revenue") * F.col("cogs_rate")))
        .withColumn("Expenses", cents(F.col("Revenue") * F.col("expense_rate")))
        .drop("discount_rate", "tax_rate", "cogs_rate", "expense_rate")
    )


def synthetic_customers(spark: SparkSession, rows: int = 3500, seed: int = 99) -> DataFrame:
    """``rows`` different customers out of CUST00001 .. CUST04999."""
    if rows > 4999:
        raise ValueError("there are 4999 customers")
    dice = _Dice(seed)
    picked = spark.range(1, 5000).orderBy(dice.unit(), "id").limit(rows)
    return picked.select(
        _customer_id(F.col("id")).alias("Customer ID"),
        F.concat(F.lit("Customer "), F.right(_customer_id(F.col("id")), F.lit(4))).alias(
            "Customer Name"
        ),
        dice.choice(SEGMENTS).alias("Segment"),
        dice.choice(REGIONS).alias("Region"),
        dice.weighted(TIERS).alias("Loyalty Tier"),
        dice.day("2015-01-01", 3653).alias("Signup Date"),
    )


def product_master(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(PRODUCT_MASTER),
        "Product string, Category string, `Unit Cost` double, Supplier string",
    )

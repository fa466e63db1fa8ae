"""What describing pictures costs: a small price table joined by provider."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Dollars for a million tokens in and out, tokens for a picture in and out.
PRICES = {
    "anthropic": (3.00, 15.00, 1600, 320),
    "google": (0.30, 2.50, 1300, 320),
    "openai": (2.50, 10.00, 1450, 320),
    "openai_compatible": (5.00, 15.00, 1600, 320),
    "anthropic_compatible": (5.00, 15.00, 1600, 320),
}
OTHERS = (5.00, 15.00, 1600, 320)
FREE = ("ollama_local",)


# A price file's keys in the order of the tuples above, and its entries that are no providers.
PRICE_KEYS = ("input_per_million_tokens", "output_per_million_tokens", "tokens_per_image", "output_tokens_per_image")
NO_PROVIDERS = ("version", "currency")


def price_file(path: str) -> dict:
    """A TOML file's tables of providers as an overlay for `price_table`: what a table leaves out comes
    from the built-in prices, else the careful ones. A file that is missing or broken changes nothing."""
    try:
        with open(path, "rb") as file:
            found = tomllib.load(file)
    except (OSError, tomllib.TOMLDecodeError):
        return {}
    tables = {name: x for name, x in found.items() if isinstance(x, dict) and name not in NO_PROVIDERS}
    value = lambda name, x, k: x[key] if isinstance(x.get(key := PRICE_KEYS[k]), int | float) else PRICES.get(name, OTHERS)[k]
    return {name: tuple(value(name, x, k) for k in range(len(PRICE_KEYS))) for name, x in tables.items()}


def price_table(spark: SparkSession, own: dict | None = None) -> DataFrame:
    rows = [(name, *map(float, p[:2]), *map(int, p[2:])) for name, p in (PRICES | (own or {})).items()]
    return spark.createDataFrame(rows, "provider string, usd_in double, usd_out double, tokens_in int, tokens_out int")


def estimate(work: DataFrame, prices: DataFrame) -> DataFrame:
    """work (provider, pictures) with input_tokens, output_tokens and usd: null without a
    charge, and the most careful price for providers that aren't in the table."""
    p = work.join(F.broadcast(prices), "provider", "left")
    free = F.col("provider").isin(*FREE)
    of = lambda name, k: F.coalesce(F.col(name), F.lit(OTHERS[k]))
    tin, tout = (F.when(free, 0).otherwise(F.col("pictures") * of(c, k)).cast("long") for c, k in (("tokens_in", 2), ("tokens_out", 3)))
    usd = F.bround(tin / 1_000_000 * of("usd_in", 0) + tout / 1_000_000 * of("usd_out", 1), 6)
    return p.select(*work.columns, tin.alias("input_tokens"), tout.alias("output_tokens"), F.when(~free, usd).alias("usd"))


def cost_label(usd: Column, digits: int = 4) -> Column:
    return F.when(usd.isNull(), "No provider charge").otherwise(F.concat(F.lit("$"), F.bround(usd.cast("decimal(18,6)"), digits).cast(f"decimal(18,{digits})").cast("string")))


def applies(provider: Column) -> Column:
    """False where there is no charge to limit."""
    return ~provider.isin(*FREE)


def remaining(spent: Column, limit: Column) -> Column:
    return F.greatest(limit - spent, F.lit(0.0))


def exhausted(spent: Column, limit: Column, provider: Column) -> Column:
    return applies(provider) & (spent >= limit)


def would_exceed(spent: Column, following: Column, limit: Column, provider: Column) -> Column:
    return applies(provider) & (spent + following > limit)

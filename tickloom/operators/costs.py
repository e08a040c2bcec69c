"""Costs of runs by price lists whose tiers a run may or may not state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("context_tier", "service_tier")
#: Stands for a tier that a run doesn't state.
ANY = "*"


def attach(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """`runs` with status, price_as_of, and input_cost, cached_cost, output_cost, total_cost in money.

    A run (model, run_day, tiers, token counts) takes the newest price of its model up to its day: a tier that it
    states must be the price's, `standard` where the price names none; one that it doesn't state may be any. Every
    price stands under each of the four ways to ask for it, so a run asks with one key, and runs and prices are one
    sorted stream, never pairs. Of prices of one day the first (smallest seq) counts. Only prices per million tokens
    count. Status: tokens_unavailable (a count lacks, is negative or not finite), price_unavailable (no such price,
    or one whose rates or currency are no good), ready. Costs are rounded to twelve places.
    """
    rates = ["input_rate", "cached_rate", "output_rate"]
    named = {tier: F.coalesce(F.nullif(tier, F.lit("")), F.lit("standard")) for tier in TIERS}
    usable = prices.where("unit = 'per_million_tokens' AND as_of IS NOT NULL AND model IS NOT NULL").withColumns(named)
    seen = F.struct(F.col("as_of").alias("price_as_of"), *rates, "currency").alias("__hit")
    usable = usable.select("model", *TIERS, F.col("as_of").alias("__at"), F.lit(1).alias("__side"), F.col("seq").alias("__seq"), seen)
    asking = runs.withColumns({f"__{tier}": F.col(tier) for tier in TIERS}).withColumns({tier: F.coalesce(F.nullif(tier, F.lit("")), F.lit(ANY)) for tier in TIERS})
    asking = asking.withColumn("__at", F.col("run_day")).withColumn("__side", F.lit(2))
    # runs and prices move once, by model; the four ways to ask are made where the model's rows are
    both = asking.unionByName(usable, allowMissingColumns=True).repartition("model")
    for tier in TIERS:
        both = both.withColumn(tier, F.explode(F.when(F.col("__side") == 1, F.array(tier, F.lit(ANY))).otherwise(F.array(tier))))
    order = ["__at", "__side", F.col("__seq").desc(), *[F.col(f"__hit.{c}").desc() for c in rates]]  # of one day's prices the first comes last
    w = Window.partitionBy("model", *TIERS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__last", F.last("__hit", ignorenulls=True).over(w)).where("__side = 2")
    met = met.select(*asking.columns, *[F.col(f"__last.{c}") for c in ("price_as_of", *rates, "currency")])
    good = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < float("inf")), F.lit(False))
    known = good("input_tokens") & good("cached_tokens") & good("output_tokens")
    priced = good("input_rate") & good("cached_rate") & good("output_rate") & F.coalesce(F.upper(F.trim("currency")).rlike("^[A-Z]{3}$"), F.lit(False))
    status = F.when(~known, "tokens_unavailable").when(~priced, "price_unavailable").otherwise("ready")
    out = met.withColumn("status", status)
    part = lambda n: F.when(F.col("status") == "ready", F.round(F.col(f"{n}_tokens") / 1_000_000.0 * F.col(f"{n}_rate"), 12))
    out = out.withColumns({f"{n}_cost": part(n) for n in ("input", "cached", "output")})
    out = out.withColumn("total_cost", F.round(F.col("input_cost") + F.col("cached_cost") + F.col("output_cost"), 12))
    kept = [c for c in runs.columns if c not in TIERS]
    ready = F.when(F.col("status") == "ready", F.col("price_as_of")).alias("price_as_of")
    return out.select(*kept, *[F.col(f"__{tier}").alias(tier) for tier in TIERS], "status", ready, "input_cost", "cached_cost", "output_cost", "total_cost")

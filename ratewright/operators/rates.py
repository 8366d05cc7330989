"""From payer rates to rate observations and the marts built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks

NOT_DOLLARS = {"percentage": "percentage rates are not dollar amounts", "algorithm": "algorithmic rates are not stated dollar amounts"}


def observations(payer_rates: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per stated representation (dollar, percentage, algorithm) of a payer rate: one scan and one join."""
    return stated(payer_rates.join(groups.select("charge_group_id", "setting", "billing_class"), "charge_group_id"))


def stated(joined: DataFrame) -> DataFrame:
    """:func:`observations` of payer rates that have their group's setting and billing_class: the representations are an array of structs of which the stated ones are unfolded."""
    number, text, true = F.lit(None).cast("decimal(38,10)"), F.lit(None).cast("string"), F.lit(True)

    def kind(name: str, value: Column, algorithm: Column) -> Column:
        stated = value if name != "algorithm" else algorithm
        return F.when(stated.isNotNull(), F.struct(F.lit(name).alias("rate_kind"), value.alias("rate_numeric"), algorithm.alias("rate_algorithm"), (true if name == "dollar" else ~true).alias("eligible_for_segmented_comparison"), F.lit(NOT_DOLLARS.get(name)).alias("ineligible_reason")))

    kinds = F.filter(
        F.array(kind("dollar", F.col("standard_charge_dollar"), text), kind("percentage", F.col("standard_charge_percentage"), text), kind("algorithm", number, F.col("standard_charge_algorithm"))),
        lambda k: k.isNotNull(),
    )
    own = ["payer_rate_id", "charge_group_id", "payer_name", "plan_name", "methodology", "setting", "billing_class"]
    return joined.select(*own, F.inline(kinds)).select(F.concat_ws(":", "payer_rate_id", "rate_kind").alias("rate_observation_id"), *own, "rate_kind", "rate_numeric", "rate_algorithm", "eligible_for_segmented_comparison", "ineligible_reason")


def file_profile(observed: DataFrame, *file_keys: str) -> DataFrame:
    """How many observations each explicit segment has; nothing is averaged over segments."""
    return observed.groupBy(*file_keys, "methodology", "rate_kind", "eligible_for_segmented_comparison").agg(F.count("*").alias("observation_count"))


def ordered_json(order: str, *fields: str | Column) -> Column:
    """A JSON list of structs in the order of a column, nulls kept. For ``groupBy().agg()``."""
    inner = F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("_value"))
    return F.to_json(F.transform(F.array_sort(F.collect_list(inner)), lambda x: x["_value"]), {"ignoreNullFields": "false"})


def item_codes(codes: DataFrame) -> DataFrame:
    return codes.groupBy("item_id").agg(ordered_json("code_ordinal", "code", "code_type").alias("codes_json"))


def candidate_settings(modifiers: DataFrame) -> DataFrame:
    """The settings that define each canonical code, in source order, nulls among them."""
    ordered = F.array_sort(F.collect_list(F.struct("modifier_ordinal", "setting")))
    return modifiers.groupBy("canonical_code").agg(F.transform(ordered, lambda x: x["setting"]).alias("candidate_modifier_settings"))


def resolve_modifiers(charge_modifiers: DataFrame, groups: DataFrame, modifiers: DataFrame) -> DataFrame:
    """Each modifier of a charge with its definition for the charge's setting, if there is one, and how it was found.

    Hash join on the canonical code; the setting is a residual condition.
    """
    known = modifiers.select("canonical_code").distinct().withColumn("known", F.lit(True))
    placed = charge_modifiers.join(groups.select("charge_group_id", F.col("setting").alias("group_setting")), "charge_group_id")
    m = modifiers.select("modifier_id", "canonical_code", "code", "setting", "description")
    applies = (F.col("canonical_modifier_code") == F.col("m.canonical_code")) & (F.col("m.setting").isNull() | (F.col("m.setting") == "both") | (F.col("m.setting") == F.col("group_setting")))
    met = placed.join(m.alias("m"), applies, "left").join(known.alias("k"), F.col("canonical_modifier_code") == F.col("k.canonical_code"), "left")
    status = (
        F.when(F.col("m.modifier_id").isNull() & F.col("known").isNotNull(), "setting_mismatch")
        .when(F.col("m.modifier_id").isNull(), "unresolved")
        .when(F.col("m.code") == F.col("modifier_code"), "exact")
        .otherwise("canonical")
    )
    return met.select("charge_group_id", "modifier_ordinal", "modifier_code", "canonical_modifier_code", "m.modifier_id", F.col("m.setting").alias("modifier_setting"), F.col("m.description").alias("modifier_description"), status.alias("modifier_resolution_status"))


def map_payers(resolved: DataFrame, payer_rates: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every payer rate under a modified charge, with the modifier's mapping for that payer and plan."""
    p = payer_rates.select("payer_rate_id", "charge_group_id", "payer_name", "plan_name", "canonical_payer_plan_key")
    mp = mappings.select("modifier_payer_id", F.col("modifier_id").alias("of"), F.col("canonical_payer_plan_key").alias("key"), F.col("payer_name").alias("mapped_payer"), F.col("plan_name").alias("mapped_plan"), F.col("description").alias("payer_mapping_description"))
    met = p.join(resolved, "charge_group_id").join(mp, (F.col("modifier_id") == F.col("of")) & (F.col("canonical_payer_plan_key") == F.col("key")), "left")
    status = (
        F.when(F.col("modifier_resolution_status") == "setting_mismatch", "modifier_setting_mismatch")
        .when(F.col("modifier_id").isNull(), "unresolved_modifier")
        .when(F.col("modifier_payer_id").isNull(), "unresolved_payer_plan")
        .when((F.col("mapped_payer") == F.col("payer_name")) & (F.col("mapped_plan") == F.col("plan_name")), "exact")
        .otherwise("canonical")
    )
    return met.withColumn("payer_mapping_resolution_status", status).drop("of", "key", "mapped_payer", "mapped_plan")


def segmented_dollars(observed: DataFrame, groups: DataFrame, items: DataFrame, codes: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Dollar observations with their item, its codes and the modifiers' context: one row each, whatever a charge's modifiers."""
    eligible = observed.where((F.col("rate_kind") == "dollar") & F.col("eligible_for_segmented_comparison"))
    out = eligible.join(groups.select("charge_group_id", "item_id"), "charge_group_id").join(items.select("item_id", "description"), "item_id").join(item_codes(codes), "item_id")
    if context is not None:
        out = out.join(context, "payer_rate_id", "left").withColumn("modifier_context_json", F.coalesce("modifier_context_json", F.lit("[]")))
    return out


def modifier_context(mapped: DataFrame) -> DataFrame:
    fields = ["modifier_code", "modifier_description", "modifier_setting", "modifier_resolution_status", "payer_mapping_description", "payer_mapping_resolution_status"]
    return mapped.groupBy("payer_rate_id").agg(ordered_json("modifier_ordinal", *fields).alias("modifier_context_json"))


def safe_median(dollars: DataFrame, *segment: str, least_publishers: int = 2) -> DataFrame:
    """Medians within segments of one methodology that at least so many publishers state.

    Exact, and no task holds a segment's rates: equal amounts are counted in the map tasks, and the middle ones are found from the running
    counts of different amounts, in two levels (blocks of amounts by their leading digits, then within the block that holds the middle).
    """
    value = F.col("rate_numeric").cast("double")
    # the input, often a star join, is read once: equal amounts of a publisher are one row from here on
    counted = dollars.groupBy(*segment, "publisher_id", value.alias("value_")).agg(F.count("*").alias("n_"))
    kept = sinks.scratch(dollars.sparkSession, "amounts")
    counted.write.parquet(kept)
    counted = dollars.sparkSession.read.schema(counted.schema).parquet(kept)
    shape = counted.groupBy(*segment).agg(F.countDistinct("publisher_id").alias("publisher_count"), F.sum("n_").alias("rate_count"), F.coalesce(F.sum(F.when(F.col("value_").isNotNull(), F.col("n_"))), F.lit(0)).alias("stated_")).where(F.col("publisher_count") >= least_publishers)
    amounts = counted.where("value_ is not null").groupBy(*segment, "value_").agg(F.sum("n_").alias("n_"))
    amounts = amounts.withColumn("block_", F.floor(F.col("value_") / F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10(F.greatest(F.abs("value_"), F.lit(1.0)))) - 1))) * F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10(F.greatest(F.abs("value_"), F.lit(1.0)))) - 1)))
    before = Window.partitionBy(*segment).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = amounts.groupBy(*segment, "block_").agg(F.sum("n_").alias("in_block_")).withColumn("before_", F.coalesce(F.sum("in_block_").over(before), F.lit(0)))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in segment], F.lit(True))
    own = blocks.alias("b").join(shape.alias("s"), same("b", "s")).select("b.*", "s.stated_")
    # places from 1 of the two middle amounts, which may be one
    low, high = F.floor((F.col("stated_") + 1) / 2), F.floor(F.col("stated_") / 2) + 1
    own = own.where((F.col("before_") < high) & (F.col("before_") + F.col("in_block_") >= low))
    within = Window.partitionBy(*segment, "block_").orderBy("value_").rowsBetween(Window.unboundedPreceding, -1)
    near = amounts.alias("a").join(own.alias("o"), same("a", "o") & (F.col("a.block_") == F.col("o.block_"))).select("a.*", "o.before_", "o.stated_")
    near = near.withColumn("from_", F.col("before_") + F.coalesce(F.sum("n_").over(within), F.lit(0)))
    middle = near.where((F.col("from_") < high) & (F.col("from_") + F.col("n_") >= low)).groupBy(*segment).agg(F.avg("value_").alias("median_dollar"))
    return shape.alias("s").join(middle.alias("m"), same("s", "m"), "left").select(*[F.col(f"s.{c}") for c in segment], "publisher_count", "rate_count", "median_dollar")


def exploratory(mart: DataFrame, least_publishers: int = 2) -> DataFrame:
    """Medians of the dollar mart by codes, methodology and setting, those of most publishers first."""
    return safe_median(mart, "codes_json", "methodology", "setting", least_publishers=least_publishers).orderBy(F.desc("publisher_count"), "codes_json", "methodology", "setting")


def ordered_profile(profile: DataFrame) -> DataFrame:
    return profile.orderBy("methodology", "rate_kind")

"""Row-level cleaning and classification (B1-B15, B21, B22) as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions import fixed
from tillpoint.functions.expr import c


def parse_currency(x) -> Column:
    """B1: '$1,234.50' / '-$5.00' -> 1234.5 / -5.0; blanks and junk -> null."""
    return _try_double(F.replace(F.replace(c(x).cast("string"), F.lit("$"), F.lit("")), F.lit(","), F.lit("")))


def _try_double(s: Column) -> Column:
    return F.when(F.trim(s) == "", F.lit(None)).otherwise(s.try_cast("double"))


def parse_percent(x) -> Column:
    """B2: '12.5%' -> 12.5."""
    return _try_double(F.regexp_replace(c(x).cast("string"), "%", ""))


def parse_timestamp(x, fmt: str = "M/d/yyyy h:mm:ss a") -> Column:
    """POS timestamp text -> timestamp_ntz (null when unparseable)."""
    return F.try_to_timestamp(c(x), F.lit(fmt)).cast("timestamp_ntz")


def coerce_quantity(x) -> Column:
    """Numeric text -> int, fractions truncated, junk/blank -> 0."""
    return F.coalesce(c(x).cast("string").try_cast("double").cast("long").cast("int"), F.lit(0))


def clean_store(x) -> Column:
    """Drop the ' - RD<digits>' licence suffix and trim."""
    return F.trim(F.regexp_replace(c(x), r" - RD\d+", ""))


def normalize_category(cat_upper: Column, aliases: dict | None = None) -> Column:
    """Exact-match alias map as a literal map lookup (no join, codegen'd)."""
    aliases = fixed.CATEGORY_ALIASES if aliases is None else aliases
    m = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(F.element_at(m, cat_upper), cat_upper) if aliases else cat_upper


def classify_transaction(deals_upper, product_clean, actual_revenue) -> Column:
    """TESTER > MARKOUT > REWARD > COMP > REGULAR (vectorised priority)."""
    d = F.coalesce(c(deals_upper), F.lit(""))
    p = F.coalesce(c(product_clean), F.lit(""))
    rev = F.coalesce(c(actual_revenue), F.lit(0.0))
    return (
        F.when(p.contains(fixed.TESTER_WORD) | d.contains(fixed.TESTER_WORD), "TESTER")
        .when(d.rlike(fixed.MARKOUT_PATTERN), "MARKOUT")
        .when(d.rlike(fixed.REWARD_PATTERN), "REWARD")
        .when((rev <= fixed.COMP_REVENUE_MAX) & ~p.contains(fixed.EXIT_BAG_WORD), "COMP")
        .otherwise("REGULAR")
    )


def classify_transaction_legacy(deals_upper, product_clean, actual_revenue) -> Column:
    """B10 variant: row-form priority REWARD > MARKOUT > TESTER > COMP."""
    d = F.coalesce(c(deals_upper), F.lit(""))
    p = F.coalesce(c(product_clean), F.lit(""))
    rev = F.coalesce(c(actual_revenue), F.lit(0.0))
    return (
        F.when(d.rlike(fixed.REWARD_PATTERN), "REWARD")
        .when(d.rlike(fixed.MARKOUT_PATTERN), "MARKOUT")
        .when(p.contains(fixed.TESTER_WORD) | d.contains(fixed.TESTER_WORD), "TESTER")
        .when((rev <= fixed.COMP_REVENUE_MAX) & ~p.contains(fixed.EXIT_BAG_WORD), "COMP")
        .otherwise("REGULAR")
    )


def classify_deal_type(deals_upper, inline_discounts) -> Column:
    """NO DEAL / BUNDLE / PERCENT OFF / CUSTOMER DISCOUNT / PRICE DEAL / OTHER."""
    d = F.coalesce(c(deals_upper), F.lit(""))
    i = F.upper(F.coalesce(c(inline_discounts).cast("string"), F.lit("")))
    comb = F.concat(d, F.lit(" "), i)
    return (
        F.when((d == "") & (i == ""), "NO DEAL")
        .when(comb.rlike(fixed.BUNDLE_PATTERN), "BUNDLE")
        .when(comb.rlike(fixed.PERCENT_PATTERN), "PERCENT OFF")
        .when(comb.rlike(fixed.CUSTOMER_DISCOUNT_PATTERN), "CUSTOMER DISCOUNT")
        .when(comb.rlike(fixed.PRICE_DEAL_PATTERN), "PRICE DEAL")
        .otherwise("OTHER")
    )


def customer_segment(groups) -> Column:
    """First keyword hit in the ordered list; null/'' -> Regular; else Other Group."""
    g = F.upper(c(groups))
    expr = F.when(c(groups).isNull() | (c(groups) == ""), "Regular")
    for kw, seg in fixed.CUSTOMER_SEGMENTS:
        expr = expr.when(g.contains(kw), seg)
    return expr.otherwise("Other Group")


def extract_reward_name(deals) -> Column:
    """B13: 'REWARD - n Points - <text>' (to the next comma), else the whole text if it says REWARD."""
    m = F.trim(F.regexp_extract(c(deals), fixed.REWARD_NAME_PATTERN, 1))
    return (
        F.when(c(deals).isNull(), F.lit(None))
        .when(m != "", m)
        .when(F.upper(c(deals)).contains("REWARD"), F.trim(c(deals)))
    )


def cost_class(category_clean, product) -> Column:
    """B14 helper: the cost class of a line for house-brand rules."""
    cat = c(category_clean)
    p = F.upper(F.coalesce(c(product), F.lit("")))
    half = None
    for kw in fixed.FLOWER_HALF_OZ_KEYWORDS:
        half = p.contains(kw) if half is None else (half | p.contains(kw))
    return (
        F.when(cat.isin(fixed.PRE_ROLL_CATEGORIES), "pre_roll")
        .when(cat.isin(fixed.CART_CATEGORIES), "cart")
        .when(cat.isin(fixed.DISPOSABLE_CATEGORIES), "disposable")
        .when(cat.isin(fixed.FLOWER_CATEGORIES) & half, "flower_half_oz")
        .when(cat.isin(fixed.FLOWER_CATEGORIES), "flower_eighth")
        .otherwise("default")
    )


def correct_costs(df: DataFrame, rules: dict | None = None, mode: str = "unconditional") -> DataFrame:
    """House-brand standard costs.

    A literal rule map keyed by 'BRAND|class' (falls back to 'BRAND|default');
    rows without a rule keep their cost. ``mode='conditional'`` only rewrites
    lines whose cost per item is below $1.
    """
    rules = fixed.INTERNAL_BRAND_COSTS if rules is None else rules
    kv = []
    for brand, prices in rules.items():
        for cls, unit in prices.items():
            kv += [F.lit(f"{brand}|{cls}"), F.lit(float(unit))]
    m = F.create_map(*kv)
    b = F.upper(F.col("brand_clean"))
    cls = cost_class(F.col("category_clean"), F.col("product"))
    unit = F.coalesce(F.element_at(m, F.concat(b, F.lit("|"), cls)),
                      F.element_at(m, F.concat(b, F.lit("|default"))))
    if mode == "conditional":
        unit = F.when(F.col("cost_per_item") < 1.0, unit)
    new_cost = F.rint(F.col("quantity").cast("double") * unit * 100) / 100.0
    return (
        df.withColumn("_unit", unit)
        .withColumn("cost", F.when(F.col("_unit").isNotNull(), new_cost).otherwise(F.col("cost")))
        .withColumn("cost_per_item", F.coalesce(F.col("_unit"), F.col("cost_per_item")))
        .withColumn("net_profit", F.when(F.col("_unit").isNotNull(),
                                         F.rint((F.col("actual_revenue") - F.col("cost")) * 100) / 100.0)
                    .otherwise(F.col("net_profit")))
        .drop("_unit")
    )


def exclude_stores(df: DataFrame, stores=None) -> DataFrame:
    """Drop excluded stores; null stores are kept (pandas ~isin semantics)."""
    stores = fixed.EXCLUDED_STORES if stores is None else stores
    if not stores:
        return df
    return df.where(F.coalesce(~F.col("store_clean").isin(list(stores)), F.lit(True)))


def brand_slug(name) -> Column:
    """B21 base slug: lower+trim, drop non-word punctuation, whitespace/_ runs -> '-'."""
    s = F.lower(F.trim(c(name)))
    s = F.regexp_replace(s, r"[^\w\s-]", "")
    s = F.regexp_replace(s, r"[\s_]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when((s == "") | s.isNull(), F.lit("unknown")).otherwise(s)


def internal_brand(brand) -> Column:
    """House-brand flag."""
    return F.upper(F.trim(c(brand))).isin(fixed.INTERNAL_BRANDS)

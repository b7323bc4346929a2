"""Staff scoring (P1-P5) and rewards / markouts (Q1-Q4)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.clean import extract_reward_name
from tillpoint.functions.expr import cents, isum, msum, msum_if, r, safe_div
from tillpoint.plans.curate import materialize
from tillpoint.plans.prefix import global_running


def staff_table(sales: DataFrame) -> DataFrame:
    """Staff performance table (A4 shape) derived from the sales lines of the test model.

    One row per seller x store: carts, units, sales, average cart and units
    per cart, % of sales discounted, loyalty enrolments (supplier key mod 17).
    """
    g = sales.where(F.col("sold_by").isNotNull()).groupBy(F.col("sold_by").alias("budtender"),
                                                          F.col("store_clean").alias("store")).agg(
        F.countDistinct("receipt_id").alias("num_transactions"), isum("quantity").alias("units_sold"),
        msum("actual_revenue").alias("total_sales"), msum_if(F.col("has_discount"), "actual_revenue").alias("_disc"))
    key = F.regexp_extract(F.col("budtender"), r"(\d+)$", 1).cast("long")
    return g.select(
        "budtender", "store", "num_transactions", "units_sold", "total_sales",
        r(safe_div(F.col("total_sales"), F.col("num_transactions")), 2).alias("avg_cart_value"),
        r(safe_div(F.col("units_sold"), F.col("num_transactions")), 2).alias("avg_units_per_cart"),
        r(safe_div(F.col("_disc"), F.col("total_sales")) * 100, 1).alias("pct_sales_discounted"),
        (key % 17).alias("loyalty_enrollments"))


def face_to_face_pct(sales: DataFrame) -> DataFrame:
    """Per seller, % of lines whose order type is walk-in / in-store / face to face."""
    f2f = F.upper(F.coalesce(F.col("order_type"), F.lit(""))).rlike(fixed.F2F_PATTERN)
    return sales.where(F.col("sold_by").isNotNull()).groupBy(F.col("sold_by").alias("budtender")).agg(
        (F.avg(F.when(f2f, 1.0).otherwise(0.0)) * 100).alias("face_to_face_pct"))


def sales_scores(staff: DataFrame, sales: DataFrame | None = None,
                 min_transactions: int = 0) -> DataFrame:
    """P2 + P3: 0-100 sales score from five weighted parts, and the tier, of every seller with at least
    ``min_transactions`` (fixed.BT_MIN_TRANSACTIONS for the usual report).

    Min/max of the eligible rows are scalar subqueries (one row each); if no
    row is eligible every row scores 0.
    """
    if sales is not None:
        st = staff.join(face_to_face_pct(sales), "budtender", "left")
    else:
        st = staff.withColumn("face_to_face_pct", F.lit(0.0))
    st = st.withColumn("face_to_face_pct", F.coalesce(F.col("face_to_face_pct"), F.lit(0.0)))
    st = materialize(staff.sparkSession, st, "staff", None)  # a row a seller and store, looked at several times
    elig = st.where(F.col("num_transactions") >= min_transactions)
    n_elig = elig.agg(F.count(F.lit(1))).scalar()
    mm = elig.agg(F.min("avg_cart_value").alias("cmin"), F.max("avg_cart_value").alias("cmax"),
                  F.min("avg_units_per_cart").alias("umin"), F.max("avg_units_per_cart").alias("umax"),
                  F.max("loyalty_enrollments").alias("lmax"))
    cmin, cmax = mm.select("cmin").scalar(), mm.select("cmax").scalar()
    umin, umax = mm.select("umin").scalar(), mm.select("umax").scalar()
    lmax = mm.select("lmax").scalar()
    cart = (F.col("avg_cart_value") - cmin) / (cmax - cmin + 0.01) * fixed.BT_WEIGHT_CART
    units = (F.col("avg_units_per_cart") - umin) / (umax - umin + 0.01) * fixed.BT_WEIGHT_UNITS
    disc = (100 - F.col("pct_sales_discounted")) / 100 * fixed.BT_WEIGHT_DISCOUNT
    loy = F.when(lmax > 0, F.col("loyalty_enrollments") / lmax * fixed.BT_WEIGHT_LOYALTY).otherwise(F.lit(0.0))
    f2f = F.col("face_to_face_pct") / 100 * fixed.BT_WEIGHT_F2F
    score = F.bround(cart + units + disc + loy + f2f, 0)  # pandas round: half to even
    scored = st.where((F.col("num_transactions") >= min_transactions) | (n_elig == 0)) \
        .withColumn("sales_score", F.when(n_elig > 0, score).otherwise(F.lit(0.0)))
    s = F.col("sales_score")
    tier = (F.when(s >= fixed.BT_TIER_TOP, "Top Performer").when(s >= fixed.BT_TIER_SOLID, "Solid")
            .when(s >= fixed.BT_TIER_DEVELOPING, "Developing").otherwise("Needs Coaching"))
    return scored.withColumn("tier", tier).withColumn("face_to_face_pct", r(F.col("face_to_face_pct"), 4))


def staff_summary(scored: DataFrame) -> DataFrame:
    """Headcount, mean score, top performers, needs coaching."""
    return scored.agg(F.count(F.lit(1)).alias("total_budtenders"), r(F.avg("sales_score"), 1).alias("avg_sales_score"),
                      F.count(F.when(F.col("tier") == "Top Performer", 1)).alias("top_performers"),
                      F.count(F.when(F.col("tier") == "Needs Coaching", 1)).alias("needs_coaching"))


def staff_by_store(scored: DataFrame) -> DataFrame:
    """P5: ranking within each store (score desc, then name)."""
    w = Window.partitionBy("store").orderBy(F.desc("sales_score"), "budtender")
    return scored.select("store", "budtender", "sales_score", "tier", F.row_number().over(w).alias("store_rank"))


# --- rewards -----------------------------------------------------------------

def rewards_summary(sales: DataFrame) -> DataFrame:
    """Q1: net cost (cost - collected) of rewards and markouts; monthly projection over the sales span."""
    rw, mk = F.col("transaction_type") == "REWARD", F.col("transaction_type") == "MARKOUT"
    g = sales.agg(
        F.sum(F.when(rw, cents("cost"))).alias("_rc"), F.sum(F.when(rw, cents("actual_revenue"))).alias("_rr"),
        F.sum(F.when(mk, cents("cost"))).alias("_mc"), F.sum(F.when(mk, cents("actual_revenue"))).alias("_mr"),
        F.greatest(F.datediff(F.max("sale_date"), F.min("sale_date")) + 1, F.lit(1)).alias("_days"),
        F.count(F.when(rw, 1)).alias("reward_redemptions"),
        F.countDistinct(F.when(rw, F.col("customer_id"))).alias("unique_reward_customers"),
        F.count(F.when(mk, 1)).alias("markout_transactions"),
        F.countDistinct(F.when(mk, F.col("customer_name"))).alias("employees_using_markouts"))
    rn = (F.coalesce(F.col("_rc"), F.lit(0)) - F.coalesce(F.col("_rr"), F.lit(0))).cast("double") / 100
    mn = (F.coalesce(F.col("_mc"), F.lit(0)) - F.coalesce(F.col("_mr"), F.lit(0))).cast("double") / 100
    return g.select(rn.alias("rewards_net_cost"), mn.alias("markouts_net_cost"),
                    r(rn + mn, 2).alias("total_net_cost"), r((rn + mn) / F.col("_days") * 30, 2).alias("monthly_projection"),
                    "reward_redemptions", "unique_reward_customers", "markout_transactions", "employees_using_markouts")


def _reward_lines(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("transaction_type") == "REWARD").withColumn("reward_name",
                                                                       extract_reward_name(F.col("deals_used")))


def _reward_aggs() -> list:
    return [F.count(F.lit(1)).alias("redemptions"), isum("quantity").alias("units"),
            msum("pre_discount_revenue").alias("retail_value"), msum("cost").alias("cost"),
            msum("actual_revenue").alias("collected")]


def rewards_by_name(sales: DataFrame) -> DataFrame:
    """Q2: per reward name; % of the total rewards net cost."""
    rl = _reward_lines(sales)
    total = rl.agg(((F.sum(cents("cost")) - F.sum(cents("actual_revenue"))).cast("double") / 100)).scalar()
    g = rl.where(F.col("reward_name").isNotNull()).groupBy("reward_name").agg(*_reward_aggs())
    net = F.rint((F.col("cost") - F.col("collected")) * 100) / 100
    return g.select("*", net.alias("net_cost"),
                    F.when(total > 0, r(net / total * 100, 1)).otherwise(F.lit(0.0)).alias("pct"))


def rewards_by_store(sales: DataFrame) -> DataFrame:
    """Q3: per store and reward name."""
    rl = _reward_lines(sales)
    g = rl.where(F.col("reward_name").isNotNull() & F.col("store_clean").isNotNull()).groupBy(
        F.col("store_clean").alias("store"), "reward_name").agg(*_reward_aggs())
    return g.select("*", (F.rint((F.col("cost") - F.col("collected")) * 100) / 100).alias("net_cost"))


def markouts_by_employee(sales: DataFrame) -> DataFrame:
    """Q4: per employee (customer name on markout lines): lines, units, cost, primary store, first 3 products.

    Primary store = most lines (ties: store name); the product list is the
    first three distinct products alphabetically (a row_number <= 3 cut,
    never a whole-group collect) with '...' when there are more.
    """
    mk = sales.where((F.col("transaction_type") == "MARKOUT") & F.col("customer_name").isNotNull())
    g = mk.groupBy("customer_name").agg(F.count(F.lit(1)).alias("redemptions"), isum("quantity").alias("units"),
                                        msum("cost").alias("cost"), F.countDistinct("product").alias("_np"))
    ps = mk.where(F.col("store_clean").isNotNull()).groupBy("customer_name", "store_clean").agg(
        F.count(F.lit(1)).alias("_n"))
    ps = ps.withColumn("_k", F.row_number().over(Window.partitionBy("customer_name").orderBy(F.desc("_n"), "store_clean")))
    ps = ps.where(F.col("_k") == 1).select("customer_name", F.col("store_clean").alias("primary_store"))
    pr = mk.where(F.col("product").isNotNull()).select("customer_name", "product").distinct()
    pr = pr.withColumn("_k", F.row_number().over(Window.partitionBy("customer_name").orderBy("product")))
    pr = pr.where(F.col("_k") <= 3).groupBy("customer_name").agg(
        F.array_sort(F.collect_list("product")).alias("_p3"))
    x = g.join(ps, "customer_name", "left").join(pr, "customer_name", "left")
    prods = F.concat(F.concat_ws(", ", F.col("_p3")), F.when(F.col("_np") > 3, F.lit("...")).otherwise(F.lit("")))
    x = x.select("customer_name", "redemptions", "units", "cost", "primary_store", prods.alias("products"))
    return global_running(x, [F.desc("cost"), F.col("customer_name")], index_col="rank").withColumn("rank", F.col("rank").cast("int"))

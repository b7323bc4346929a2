"""Fixed values that must equal the reference behaviour for right results.

These are business constants (keyword lists, alias maps, cost rules,
thresholds). They are stated plainly, in natural order, and every other
module reads them from here.
"""
from __future__ import annotations

# --- FIXED VALUES (must match the reference's business rules) ---------------

# File discovery keywords (case-insensitive substring of the file name).
SALES_KEYWORDS = ["margin", "line_item", "john", "sales performance"]
STAFF_KEYWORDS = ["bt sales", "bt_sales", "budtender"]
CUSTOMER_KEYWORDS = ["customer"]

# Raw POS export header -> internal column name.
COLUMN_MAP = {
    "Receipt ID": "receipt_id",
    "Order Type": "order_type",
    "Sold By": "sold_by",
    "Completed At": "completed_at",
    "Customer ID": "customer_id",
    "Customer Name": "customer_name",
    "Store": "store",
    "Product": "product",
    "Variant Type": "category",
    "Brand": "brand",
    "Quantity Sold": "quantity",
    "Pre-Discount, Pre-Tax Total": "pre_discount_revenue",
    "Discounts": "discounts",
    "Taxes": "taxes",
    "Post-Discount, Pre-Tax Total": "actual_revenue",
    "Total Collected (Post-Discount, Post-Tax, Post-Fees)": "total_collected",
    "Receipt Total Collected": "receipt_total",
    "Net Profit": "net_profit",
    "Cost": "cost",
    "Cost Per Item": "cost_per_item",
    "Deals Used": "deals_used",
    "Inline/Cart Discounts Used": "inline_discounts",
}

# Money columns kept in the fact table (taxes/total_collected/receipt_total are dropped).
MONEY_COLS = ["pre_discount_revenue", "discounts", "actual_revenue", "net_profit", "cost", "cost_per_item"]

# Category alias map (exact match on the trimmed, upper-cased category).
CATEGORY_ALIASES = {
    "ACCESSORY": "ACCESSORY",
    "PRE-ROLL": "PRE ROLL",
    "PREROLL": "PRE ROLL",
    "PRE-ROLLS": "PRE ROLL",
    "PRE ROLLS": "PRE ROLL",
    "PRE-ROLL PACK": "PRE ROLL PACK",
    "PREROLL PACK": "PRE ROLL PACK",
    "VAPE": "CARTRIDGE",
    "CART": "CARTRIDGE",
    "CARTS": "CARTRIDGE",
    "DISPOSABLE": "DISPOSABLE VAPE",
    "DISPO": "DISPOSABLE VAPE",
    "GUMMY": "EDIBLE",
    "GUMMIES": "EDIBLE",
    "EDIBLES": "EDIBLE",
}

# Customer segment keywords, first match wins.
CUSTOMER_SEGMENTS = [
    ("INDUSTRY", "Industry"),
    ("EMPLOYEE", "Employee"),
    ("VETERAN", "Veteran"),
    ("MILITARY", "Veteran"),
    ("SENIOR", "Senior"),
    ("VIP", "VIP"),
    ("MEDICAL", "Medical"),
    ("MED", "Medical"),
    ("LOCAL", "Locals"),
]

# House-brand standard unit costs by cost class.
INTERNAL_BRAND_COSTS = {
    "HAUS": {"default": 6.62, "pre_roll": 4.00},
    "HUSTLE & GROW": {"default": 6.62, "pre_roll": 4.00},
    "PISTOLA": {"default": 8.63, "pre_roll": 4.00},
    "GREEN & GOLD": {"default": 8.63, "pre_roll": 4.00},
    "FADE": {"cart": 10.61, "disposable": 12.44},
    "RETREAT": {"cart": 10.61, "disposable": 12.44},
    "SRENE": {"cart": 10.76, "flower_eighth": 13.00, "flower_half_oz": 25.00},
}
FLOWER_CATEGORIES = ["FLOWER"]
FLOWER_HALF_OZ_KEYWORDS = ["HALF OUNCE", "HALF OZ", "14G"]
PRE_ROLL_CATEGORIES = ["PRE ROLL", "PRE ROLL PACK"]
CART_CATEGORIES = ["CARTRIDGE"]
DISPOSABLE_CATEGORIES = ["DISPOSABLE VAPE"]

INTERNAL_BRANDS = ["HAUS", "HUSTLE & GROW", "PISTOLA", "GREEN & GOLD", "RETREAT", "FADE", "G&G EXTRACTS"]

# Stores left out of every report; a deployment names its own.
EXCLUDED_STORES = ["Head Office"]

# Transaction classification patterns.
REWARD_PATTERN = "REWARD|POINT|REDEMPTION"
MARKOUT_PATTERN = "MARKOUT|MARK OUT|MARK-OUT"
TESTER_WORD = "TESTER"
EXIT_BAG_WORD = "EXIT BAG"
COMP_REVENUE_MAX = 1.00

# Deal type patterns (first match in this order after NO DEAL).
BUNDLE_PATTERN = r"B1G|B2G|BOGO|2 FOR|3 FOR|4 FOR|5 FOR|2/\$|3/\$|4/\$|5/\$"
PERCENT_PATTERN = "%|PERCENT"
CUSTOMER_DISCOUNT_PATTERN = "SENIOR|VETERAN|MILITARY|MEDICAL|INDUSTRY|VIP|EMPLOYEE"
PRICE_DEAL_PATTERN = r"FOR \$|FOR\$"

# Reward name pattern.
REWARD_NAME_PATTERN = r"(?i)(REWARD\s*-\s*\d+\s*Points?\s*-\s*[^,]+)"

# Face-to-face order types (staff scoring).
F2F_PATTERN = "WALK|IN-STORE|FACE"

# Sales mix health.
SALES_MIX_HEALTHY_PCT = 35
SALES_MIX_WATCH_PCT = 25

# Dashboard insight thresholds.
MARGIN_EXCELLENT_PCT = 55
MARGIN_BELOW_TARGET_PCT = 40
DISCOUNT_DEPENDENCY_PCT = 30
MARGIN_GAP_SIGNIFICANT_PTS = 15

# Recommendation thresholds.
REC_MARGIN_VS_CAT_GAP_PTS = -5
REC_PROMO_DEPENDENCY_PCT = 25
REC_LOW_DISC_MARGIN_PCT = 35
REC_VOLUME_LEVERAGE_REVENUE = 5000
REC_HIGH_PRIORITY_CATEGORY_REVENUE = 10000

# Staff scoring weights and tiers.
BT_WEIGHT_CART = 30
BT_WEIGHT_UNITS = 25
BT_WEIGHT_DISCOUNT = 20
BT_WEIGHT_LOYALTY = 15
BT_WEIGHT_F2F = 10
BT_TIER_TOP = 70
BT_TIER_SOLID = 50
BT_TIER_DEVELOPING = 30
BT_MIN_TRANSACTIONS = 5
COHORT_MIN_SIZE = 5
GAP_MIN_DEMAND = 1000.0

# Monthly operating expenses for the EBITDA proxy (zeros = not configured).
MONTHLY_OPEX = {"labor": 0, "rent": 0, "utilities": 0, "other_opex": 0, "depreciation": 0}

# Discount depth tiers: (label, lower exclusive, upper inclusive); first tier is exactly 0.
DISCOUNT_TIERS = [("0% (Full Price)", None, 0), ("1-10%", 0, 10), ("11-20%", 10, 20), ("21-30%", 20, 30), ("31%+", 30, 100)]

# Tenure buckets for LTV (days, lower exclusive, upper inclusive).
TENURE_BUCKETS = [("< 1 month", -1, 30), ("1-3 months", 30, 90), ("3-6 months", 90, 180),
                  ("6-12 months", 180, 365), ("12+ months", 365, None)]

# Basket / product / heatmap parameters.
ABC_A_PCT, ABC_B_PCT, ABC_C_PCT = 80, 95, 99
DEAD_STOCK_DAYS = 60
VELOCITY_WINDOW_DAYS = 90
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Advice texts: (severity or priority, title, detail, action) in printf form.
ADVICE_BELOW_CATEGORY = ("red", "%s: BELOW CATEGORY AVERAGE",
                         "Margin (%.1f%%) is %.0f pts below %s average. Ranked #%d of %d. Strong case for cost negotiation.",
                         "Request %.0f%% cost reduction or evaluate alternative %s brands.")
ADVICE_BENCHMARK_GAP = ("yellow", "CATEGORY BENCHMARK GAP", "Overall margin (%.1f%%) trails %s average (%.1f%%) by %.1f pts.",
                        "Negotiate cost reduction or increase retail price.")
ADVICE_PROMOTION = ("red", "HIGH PROMOTION DEPENDENCY", "Only %.0f%% sells at full price. Heavy discounting required.",
                    "Test reducing deal frequency — track velocity without promos.")
ADVICE_DISCOUNTED = ("red", "LOW DISCOUNTED MARGIN", "Margin drops to %.1f%% when discounted.",
                     "Cap discount depth at 20% or negotiate lower wholesale cost.")
ADVICE_STRONG = ("green", "STRONG PERFORMER", "Ranked #%d in %s with %.1f pts above average.",
                 "Expand shelf space and prioritize this brand in category.")
ADVICE_VOLUME = ("info", "VOLUME LEVERAGE", "$%s revenue provides negotiating leverage.",
                 "Use volume as leverage in next vendor meeting.")
REC_BELOW_CATEGORY_PTS, REC_STRONG_PTS, REC_STRONG_RANK = -10, 5, 5
REC_SKU_PRODUCTS, REC_VELOCITY_INDEX, PRICING_PRODUCTS = 5, 80, 30
GROWTH_STORE = ("Expand to %s", "Store has $%s in %s — categories where %s competes.")
GROWTH_SKU = ("Add '%s' to %d more store(s)", "Carried in %d stores. Missing from: %s")
GROWTH_VELOCITY = ("Improve velocity in %s", "Velocity index %.0f (below category average). %.1f units/day vs %.1f avg.")
INSIGHT_FULL_PRICE_PCT = 30
INSIGHT_FAR_BELOW = "%s margin (%.1f%%) is %.0f pts BELOW %s average (%.1f%%). Strong case for cost reduction."
INSIGHT_BELOW = "%s margin (%.1f%%) is slightly below %s average (%.1f%%). Room for negotiation."
INSIGHT_DISCOUNTS = "Only %.0f%% sells at full price. Heavy discounting required to move inventory."
INSIGHT_WELL = "%s performs well — ranked #%d in %s with %.1f%% margin vs %.1f%% category average."

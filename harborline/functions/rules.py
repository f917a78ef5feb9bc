"""Fixed values of the rule-based functions: keyword tables, vote weights, families, hints, currencies."""

from __future__ import annotations

# Category keywords (commerce).
CATEGORY_KEYWORDS = {
    "demand_signal": ["demand", "forecast", "orders", "volume", "traffic", "seasonality"],
    "conversion_optimization": ["conversion", "checkout", "funnel", "session", "attribution", "uplift"],
    "merchandising": ["merchandising", "assortment", "sku", "category", "gmv", "margin"],
    "basket_intelligence": ["basket", "cart", "cross-sell", "upsell", "bundle", "affinity"],
    "checkout_risk": ["checkout", "payment", "chargeback", "fraud", "risk", "decline"],
    "fulfillment_flow": ["fulfillment", "pickpack", "dispatch", "shipment", "sla", "delivery"],
    "catalog_quality": ["catalog", "listing", "content", "quality", "attributes", "search"],
}
DEFAULT_CATEGORY = "operations"

# Substrings of a target that place it in a family, per category, first match first. An empty list matches all.
TARGET_FAMILIES = {
    "customer": [
        (["sentiment", "polarity"], "sentiment_classification"),
        (["rating", "recommend", "satisf", "review"], "satisfaction_score"),
    ],
    "maintenance": [
        (["rul", "remaining", "cycle", "life"], "rul_prediction"),
        (["failure", "fault", "maint", "target"], "failure_risk"),
    ],
    "safety": [(["incident", "accident", "severity", "risk", "fatal", "damage", "value"], "incident_severity")],
    "pricing": [(["fare", "price", "ticket", "yield", "revenue", "mile"], "fare_prediction")],
    "network": [
        (["hub", "role", "node"], "hub_spoke_classification"),
        (["route", "connect", "stop", "active", "hemi", "continent", "country", "region"], "route_connectivity"),
    ],
    "operations": [
        (["status", "delay", "ontime", "onground", "sched", "vis", "weather", "reliab"], "schedule_reliability"),
        ([], "resource_efficiency"),
    ],
    "checkout_risk": [
        (["chargeback", "dispute", "refund"], "chargeback_risk"),
        (["fraud", "risk", "abuse", "amount", "price", "subscription"], "payment_fraud"),
    ],
    "conversion_optimization": [
        (["abandon", "dropoff"], "checkout_abandonment"),
        (["convert", "purchase", "quote", "class", "revenue", "unitprice", "target"], "session_conversion"),
    ],
    "basket_intelligence": [
        (["bundle", "department", "co", "affinity", "weekday", "evalset"], "bundle_affinity"),
        (["addon", "crosssell", "upsell", "cart"], "cross_sell_acceptance"),
    ],
    "catalog_quality": [(["quality", "recommend", "flow", "tier", "suppress", "discover"], "listing_quality_risk")],
    "fulfillment_flow": [
        (["exception", "overbill", "billing"], "fulfillment_exception"),
        (["delay", "late", "sla", "orderstatus", "ship"], "late_delivery"),
    ],
    "demand_signal": [
        (
            ["order", "unit", "quantity", "demand", "volume", "sales", "gmv", "revenue", "price", "state", "country", "zone"],
            "long_horizon_volume",
        )
    ],
    "merchandising": [
        (["margin", "gmv", "revenue", "price", "sales", "gross", "qty", "retail", "discount"], "sku_margin_prediction")
    ],
}

# Meaning votes: (label, weight, exact tokens, substrings) on the target's name.
MEANING_NAME_VOTES = [
    ("transactions processed", 0.90, ["tp", "txnprocessed", "transactionsprocessed"], []),
    ("remaining useful life", 0.88, [], ["rul"]),
    ("arrival delay / ETA performance", 0.82, [], ["eta", "delay"]),
    ("operational risk level", 0.84, [], ["risk", "severity"]),
    ("sales / revenue outcome", 0.82, [], ["sales", "revenue", "gmv"]),
    ("cost / spend outcome", 0.80, [], ["cost", "spend"]),
    ("volume / count outcome", 0.76, [], ["count", "volume", "units"]),
    ("observed value metric", 0.60, ["value", "value1", "value2", "obsvalue", "obs"], []),
]
# Words that hint at a meaning; each shared word adds 0.12, at most 0.45.
MEANING_BAGS = {
    "transactions processed": ["transaction", "transactions", "txn", "processed", "orders", "throughput"],
    "volume / count outcome": ["volume", "count", "units", "shipments", "deliveries", "teu", "tons"],
    "arrival delay / ETA performance": ["eta", "arrival", "delay", "travel", "transit", "duration", "time"],
    "sales / revenue outcome": ["sales", "revenue", "gmv", "basket", "aov", "conversion", "checkout"],
    "cost / spend outcome": ["cost", "spend", "price", "fare", "expense", "fuel"],
    "operational risk level": ["risk", "incident", "safety", "fraud", "violation", "severity"],
}
# One vote per observed property of the values.
MEANING_HINT_VOTES = [
    ("bounded_ratio_target", "rate / probability metric", 0.25),
    ("high_magnitude_target", "sales / revenue outcome", 0.12),
    ("non_negative_target", "volume / count outcome", 0.08),
]
MEANING_FALLBACK = ("operational target metric", 0.45)

# Category of an open-data title: first rule with a keyword in it.
TITLE_HINTS = [
    ("last_mile_sla", ["courier", "delivery", "last mile", "on-time"]),
    ("fleet_utilization", ["vehicle", "operator licence", "fleet", "hgv", "lgv", "truck", "van"]),
    ("carrier_safety_risk", ["accident", "incident", "safety", "casualty", "violation"]),
    ("cold_chain_integrity", ["cold", "temperature", "reefer", "spoilage"]),
    ("inland_waterway_flow", ["inland waterway", "river", "canal", "barge", "lock"]),
    ("customs_compliance", ["customs", "clearance", "inspection", "hs code"]),
    ("cross_border_flow", ["border", "crossing", "port of entry"]),
    ("port_terminal_congestion", ["port", "terminal", "berth", "vessel", "ship", "marine"]),
    ("trade_volume_mix", ["trade", "imports", "exports", "cargo", "container"]),
]
TITLE_HINT_DEFAULT = "trucking_capacity"

# Category of an indicator code: first prefix that fits.
CODE_HINTS = [
    ("customs_compliance", ["LP.LPI.CUST", "IC.CUS"]),
    ("eta_delay_risk", ["LP.LPI.TIME", "IC.FRM"]),
    ("ocean_schedule_reliability", ["IS.SHP.GCNW"]),
    ("trade_volume_mix", ["IS.SHP.GOOD"]),
    ("lane_cost_yield", ["LP.LPI."]),
    ("trade_volume_mix", ["TX.", "TM.", "TG."]),
]
CODE_HINT_DEFAULT = "trade_volume_mix"

# One unit of a currency in US dollars, and the texts that name it.
FX_TO_USD = {
    "usd": 1.0, "eur": 1.08, "gbp": 1.27, "jpy": 0.0067, "cad": 0.74, "aud": 0.65, "mxn": 0.058, "brl": 0.19,
    "inr": 0.012, "cny": 0.14, "krw": 0.00074, "php": 0.018, "sgd": 0.74, "hkd": 0.13, "nzd": 0.60, "chf": 1.13,
    "sek": 0.095, "nok": 0.093, "dkk": 0.14, "zar": 0.055, "thb": 0.028, "idr": 0.000063, "myr": 0.22,
    "vnd": 0.000040, "aed": 0.27, "sar": 0.27, "try": 0.031, "pln": 0.25, "czk": 0.043, "huf": 0.0027,
    "clp": 0.0011, "cop": 0.00024, "pen": 0.27, "ars": 0.0010, "egp": 0.020, "ngn": 0.00064, "kes": 0.0077,
}
CURRENCY_NAMES = {
    "eur": ["eur", "euro", "euros", "€"],
    "gbp": ["gbp", "pound", "pounds", "sterling", "£"],
    "jpy": ["jpy", "yen", "¥"],
    "cad": ["cad", "canadian dollar", "canadian dollars"],
    "aud": ["aud", "australian dollar", "australian dollars"],
    "mxn": ["mxn", "peso", "pesos"],
    "brl": ["brl", "real", "reais"],
    "inr": ["inr", "rs", "rupee", "rupees", "₹"],
    "cny": ["cny", "rmb", "yuan", "元"],
}

# Context words within 40 characters of a number that label it. Every inner list must have a hit.
ANCHOR_REACH = 40
ANCHOR_LABELS = [
    ("stockout_rate_pct", [["stockout", "out of stock"]]),
    ("on_time_rate_pct", [["on time", "on-time", "sla", "late delivery"]]),
    ("lead_time_days", [["lead time", "days", "day"]]),
    ("risk_index", [["risk", "volatility"]]),
    ("gross_margin_pct", [["margin", "gross margin", "profit margin"]]),
    ("revenue_usd", [["revenue", "sales", "income"], ["$", "usd", "dollar", "peso", "eur", "inr", "php"]]),
    ("cost_usd", [["cost", "expense", "spend", "budget", "investment", "invest"]]),
    ("customer_count", [["customer", "client"]]),
    ("orders_count", [["order", "transaction", "demand", "volume", "kg", "unit"]]),
    ("transactions_completed", [["order", "transaction", "demand", "volume", "kg", "unit"]]),
    ("demand_volume", [["order", "transaction", "demand", "volume", "kg", "unit"]]),
]
ANCHOR_PERCENT_LABELS = ["gross_margin_pct", "on_time_rate_pct", "stockout_rate_pct"]

# Month names in "since <month>".
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}

# Keys whose contents are left out when context is flattened.
NOISY_KEYS = ["intake_transcript", "assistant_messages", "raw_context"]

# Words left out of category tokens, and metric words every category takes.
TARGET_STOP_TOKENS = ["flag", "bucket", "tier", "risk", "event"]
KEYWORD_STOP_TOKENS = ["risk", "flow"]
METRIC_TOKENS = [
    "value", "obs", "figure", "count", "hours", "hour", "delay", "dwell", "wait", "time", "volume", "ton", "tons",
    "tonnage", "teu", "cost", "price", "revenue", "margin", "yield", "capacity", "utilization", "rate", "speed",
    "distance", "duration", "passenger", "incidents", "accident", "injury", "claims", "temperature",
]

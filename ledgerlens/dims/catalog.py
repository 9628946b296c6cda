"""Behaviour catalog and category weights as small dimension tables.

The catalog is user data (an extension point): callers may pass their own
``behavior``/``activity_impact``/``transition`` DataFrames to every operator
that takes a catalog.  The literals below are the default catalog.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Behaviour -> time limit in seconds, fraud flag, activities in matrix order
# with impact, and the raw (un-normalised) transition matrix, row = from-state.
# Two activity names are misspelt in the original catalog and are kept as keys:
# "Review activityments" and "Make Purchas".
# ---------------------------------------------------------------------------
BEHAVIORS = {
    "legitimate": {
        "time_limit": 10800, "fraud": 0,
        "activities": [
            ("Open Account", "neutral"), ("Deposit Funds", "positive"),
            ("Make Purchase", "negative"), ("Pay Bills", "negative"),
            ("Transfer Funds", "negative"), ("Apply for Credit Card", "neutral"),
            ("Apply for Loan", "neutral"), ("Invest Money", "negative"),
            ("Review activityments", "neutral"), ("Close Account", "neutral"),
        ],
        "matrix": [
            [0.0, 0.5, 0.2, 0.1, 0.1, 0.02, 0.02, 0.02, 0.03, 0.01],
            [0.0, 0.4, 0.3, 0.1, 0.1, 0.03, 0.02, 0.02, 0.07, 0.01],
            [0.0, 0.1, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.01, 0.0],
            [0.0, 0.1, 0.2, 0.5, 0.1, 0.03, 0.02, 0.02, 0.02, 0.0],
            [0.0, 0.2, 0.3, 0.1, 0.3, 0.02, 0.02, 0.02, 0.02, 0.01],
            [0.0, 0.1, 0.2, 0.2, 0.1, 0.3, 0.05, 0.02, 0.01, 0.01],
            [0.0, 0.1, 0.1, 0.1, 0.1, 0.02, 0.4, 0.1, 0.05, 0.02],
            [0.0, 0.05, 0.05, 0.1, 0.1, 0.02, 0.03, 0.5, 0.1, 0.05],
            [0.0, 0.05, 0.05, 0.15, 0.14, 0.02, 0.03, 0.05, 0.5, 0.01],
            [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
        ],
    },
    "identity_theft": {
        "time_limit": 1800, "fraud": 1,
        "activities": [
            ("Failed Login", "neutral"), ("Suspicious Login", "neutral"),
            ("Change Password", "neutral"), ("Change Email", "neutral"),
            ("Change Phone", "neutral"), ("Request New Card", "neutral"),
            ("Unauthorized Transfer", "negative"), ("Close Account", "neutral"),
        ],
        "matrix": [
            [0.6, 0.3, 0.05, 0.02, 0.02, 0.0, 0.01, 0.0],
            [0.1, 0.5, 0.3, 0.05, 0.03, 0.02, 0.05, 0.0],
            [0.0, 0.1, 0.5, 0.2, 0.1, 0.05, 0.05, 0.0],
            [0.0, 0.05, 0.1, 0.5, 0.2, 0.1, 0.05, 0.0],
            [0.0, 0.05, 0.1, 0.2, 0.5, 0.1, 0.04, 0.01],
            [0.0, 0.02, 0.05, 0.1, 0.1, 0.5, 0.2, 0.03],
            [0.0, 0.01, 0.02, 0.05, 0.1, 0.1, 0.6, 0.12],
            [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
        ],
    },
    "card_skimming": {
        "time_limit": 900, "fraud": 1,
        "activities": [
            ("ATM Withdrawal", "negative"), ("Online Purchase", "negative"),
            ("POS Purchase", "negative"), ("Balance Check", "neutral"),
            ("Request New PIN", "neutral"), ("Report Lost Card", "neutral"),
            ("Close Account", "neutral"),
        ],
        "matrix": [
            [0.0, 0.3, 0.3, 0.2, 0.1, 0.05, 0.05],
            [0.0, 0.4, 0.3, 0.1, 0.1, 0.05, 0.05],
            [0.0, 0.3, 0.4, 0.1, 0.1, 0.05, 0.04],
            [0.1, 0.2, 0.2, 0.2, 0.2, 0.05, 0.05],
            [0.0, 0.1, 0.1, 0.1, 0.4, 0.2, 0.1],
            [0.0, 0.05, 0.05, 0.05, 0.2, 0.5, 0.15],
            [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
        ],
    },
    "money_laundering": {
        "time_limit": 7200, "fraud": 1,
        "activities": [
            ("Open Account", "neutral"), ("Deposit Funds", "positive"),
            ("Wire Transfer", "negative"), ("Make Purchas", "negative"),
            ("Cash Withdrawal", "negative"), ("Invest in Assets", "negative"),
            ("Close Account", "neutral"),
        ],
        "matrix": [
            [0.0, 0.5, 0.3, 0.1, 0.05, 0.03, 0.02],
            [0.0, 0.2, 0.4, 0.2, 0.1, 0.05, 0.03],
            [0.0, 0.3, 0.2, 0.2, 0.1, 0.1, 0.1],
            [0.0, 0.1, 0.1, 0.4, 0.2, 0.1, 0.1],
            [0.0, 0.1, 0.1, 0.2, 0.4, 0.1, 0.1],
            [0.0, 0.1, 0.1, 0.2, 0.1, 0.4, 0.1],
            [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
        ],
    },
    "synthetic_identity_fraud": {
        "time_limit": 3600, "fraud": 1,
        "activities": [
            ("Create Fake Identity", "neutral"), ("Open Account", "neutral"),
            ("Apply for Credit Card", "neutral"), ("Apply for Loan", "neutral"),
            ("Make Purchase", "negative"), ("Max Out Credit", "negative"),
            ("Withdraw Funds", "negative"), ("Close Account", "neutral"),
        ],
        "matrix": [
            [0.4, 0.3, 0.1, 0.1, 0.05, 0.01, 0.01, 0.03],
            [0.3, 0.3, 0.2, 0.1, 0.05, 0.01, 0.01, 0.01],
            [0.2, 0.3, 0.3, 0.1, 0.05, 0.02, 0.02, 0.02],
            [0.1, 0.2, 0.2, 0.4, 0.1, 0.02, 0.02, 0.02],
            [0.1, 0.1, 0.2, 0.1, 0.3, 0.1, 0.1, 0.1],
            [0.05, 0.05, 0.1, 0.1, 0.2, 0.3, 0.1, 0.1],
            [0.05, 0.05, 0.1, 0.1, 0.1, 0.2, 0.3, 0.1],
            [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
        ],
    },
}

# Category weights and country tables.
DEVICES = ["iPhone", "Android", "Windows Laptop", "MacBook", "Linux PC", "iPad"]
DEVICE_WEIGHTS = [0.3, 0.25, 0.2, 0.15, 0.05, 0.05]
NETWORKS = ["Home WiFi", "Public WiFi", "Mobile Network", "Corporate Network"]
NETWORK_WEIGHTS = [0.4, 0.3, 0.2, 0.1]
HOME_COUNTRIES = ["USA", "UK", "China", "Japan", "France", "Germany"]
FRAUD_RATE_BY_COUNTRY = [
    ("Nigeria", 0.25), ("Russia", 0.20), ("China", 0.18), ("India", 0.15), ("Brazil", 0.12),
    ("USA", 0.08), ("UK", 0.06), ("Germany", 0.05), ("France", 0.04), ("Canada", 0.03),
]
FRAUD_OFFSHORE = ["Switzerland", "Cayman Islands", "Hong Kong", "Singapore"]
FRAUD_ONSHORE = ["USA", "UK", "France", "Germany", "Canada"]
TRAVEL_COUNTRIES = ["France", "UK", "USA", "Germany", "Japan"]

# Merchant weights by transaction kind.
MERCHANTS_BY_KIND = {
    "purchase": [("Walmart", 0.15), ("Best Buy", 0.2), ("Target", 0.1), ("Starbucks", 0.1), ("Apple", 0.1),
                 ("Amazon", 0.25), ("PayPal", 0.1)],
    "deposit": [("Bank", 0.4), ("ATM", 0.3), ("PayPal", 0.3)],
    "withdrawal": [("Bank", 0.5), ("ATM", 0.5)],
}

FRAUD_BEHAVIORS = [b for b, d in BEHAVIORS.items() if d["fraud"] == 1]
CLOSE = "Close Account"


# ---- rows for DataFrames / SQL VALUES ------------------------------------

def behavior_rows():
    return [(b, d["time_limit"], d["fraud"]) for b, d in BEHAVIORS.items()]


def impact_rows():
    return [(b, i, a, imp) for b, d in BEHAVIORS.items() for i, (a, imp) in enumerate(d["activities"])]


def transition_rows(include_zero: bool = False):
    out = []
    for b, d in BEHAVIORS.items():
        acts = [a for a, _ in d["activities"]]
        for i, row in enumerate(d["matrix"]):
            for j, p in enumerate(row):
                if include_zero or p != 0.0:
                    out.append((b, i, acts[i], j, acts[j], float(p)))
    return out


BEHAVIOR_SCHEMA = "behavior string, time_limit_s int, fraud int"
IMPACT_SCHEMA = "behavior string, idx int, activity string, impact string"
TRANSITION_SCHEMA = ("behavior string, from_idx int, from_activity string, to_idx int, "
                     "to_activity string, p double")


def behavior_df(spark):
    return spark.createDataFrame(behavior_rows(), BEHAVIOR_SCHEMA)


def impact_df(spark):
    return spark.createDataFrame(impact_rows(), IMPACT_SCHEMA)


def transition_df(spark, include_zero: bool = False):
    return spark.createDataFrame(transition_rows(include_zero), TRANSITION_SCHEMA)


def values_sql(rows, cols: list[str]) -> str:
    """``(VALUES ...) AS t(cols)`` text for DuckDB oracles."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"

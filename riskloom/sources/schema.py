"""Schemas, feature order and the fixed dimensions of the transaction domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("tx_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("tx_type", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("is_vpn", T.IntegerType()),
    T.StructField("remote_access", T.IntegerType()),
    T.StructField("call_minutes_before", T.DoubleType()),
    T.StructField("session_duration_s", T.DoubleType()),
    T.StructField("recipient_id", T.StringType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("fraud_type", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

PROFILE_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("home_city", T.StringType()),
    T.StructField("avg_ticket", T.DoubleType()),
    T.StructField("tenure_days", T.IntegerType()),
])

# ---- fixed values: feature names in model order -------------------------------------------
FEATURES = [
    "log_amount", "amount_to_avg", "amount_z", "amount_to_max", "is_amount_record", "is_round_amount",
    "hour", "is_night", "is_weekend", "hours_since_prev", "tx_count_1h", "tx_count_24h",
    "amount_24h_to_avg",
    "is_new_device", "device_tx_share", "device_age_days",
    "is_new_city", "city_tx_share", "is_foreign", "distance_from_home_km", "distance_from_prev_km",
    "travel_speed_kmh", "is_vpn",
    "clients_per_device", "clients_per_ip", "clients_per_recipient", "is_new_recipient",
    "recipient_clients_24h", "recipient_clients_7d", "recipient_inbound_24h", "recipient_amount_24h",
    "recipient_age_days", "recipient_is_new_to_bank", "device_clients_24h", "ip_clients_24h",
    "component_clients", "component_size",
    "remote_access", "call_minutes_before", "has_long_call", "session_duration_s",
    "category_risk", "is_new_category", "channel_code", "tx_type_code", "is_transfer",
    "client_age", "client_tenure_days", "history_len", "night_share", "own_context",
]

# ---- fixed values: features the unsupervised channel looks at -----------------------------
ANOMALY_FEATURES = [
    "amount_to_avg", "amount_z", "amount_to_max", "is_amount_record", "hours_since_prev",
    "tx_count_1h", "tx_count_24h", "amount_24h_to_avg", "is_new_device", "device_tx_share",
    "device_age_days", "is_new_city", "city_tx_share", "distance_from_home_km", "travel_speed_kmh",
    "is_vpn", "clients_per_device", "clients_per_ip", "recipient_clients_24h",
    "recipient_inbound_24h", "recipient_amount_24h", "recipient_is_new_to_bank",
    "component_clients", "is_new_recipient", "is_new_category", "remote_access",
    "call_minutes_before", "session_duration_s", "own_context",
]

# ---- fixed values: features added by the link network (left out by the ablation) ----------
NETWORK_FEATURES = [
    "recipient_clients_24h", "recipient_clients_7d", "recipient_inbound_24h", "recipient_amount_24h",
    "recipient_age_days", "recipient_is_new_to_bank", "device_clients_24h", "ip_clients_24h",
    "component_clients", "component_size",
]

# ---- fixed values: features that grow with the stream by construction ---------------------
ACCUMULATING = [
    "device_age_days", "history_len", "component_size", "component_clients", "client_tenure_days",
    "recipient_age_days", "amount_to_max", "amount_z", "clients_per_device", "clients_per_ip",
    "clients_per_recipient", "device_tx_share", "city_tx_share", "night_share",
]

# ---- fixed values: code lists -------------------------------------------------------------
CHANNELS = ["pos", "ecom", "mobile_app", "atm", "p2p"]
TX_TYPES = ["purchase", "transfer", "withdrawal"]
SCHEMES = ["stolen_card", "social_eng", "fraud_ring"]
ACTIONS = ["allow", "step_up", "hold", "block"]

# ---- fixed values: risk weight by merchant category ---------------------------------------
CATEGORY_RISK = {
    "grocery": 0.05, "transport": 0.05, "cafe": 0.08, "pharmacy": 0.05, "utilities": 0.05,
    "marketplace": 0.25, "clothing": 0.20, "electronics": 0.55, "entertainment": 0.20,
    "travel": 0.45, "jewelry": 0.70, "crypto": 0.90, "gambling": 0.85, "atm_withdrawal": 0.60,
    "transfer_p2p": 0.50,
}
UNKNOWN_CATEGORY_RISK = 0.3

# ---- fixed values: known places (name, latitude, longitude, country) ----------------------
PLACES = [
    ("Алматы", 43.2220, 76.8512, "KZ"), ("Астана", 51.1694, 71.4491, "KZ"),
    ("Шымкент", 42.3417, 69.5901, "KZ"), ("Караганда", 49.8047, 73.1094, "KZ"),
    ("Актобе", 50.2839, 57.1670, "KZ"), ("Тараз", 42.9000, 71.3667, "KZ"),
    ("Павлодар", 52.2871, 76.9674, "KZ"), ("Усть-Каменогорск", 49.9787, 82.6014, "KZ"),
    ("Семей", 50.4111, 80.2275, "KZ"), ("Атырау", 47.0945, 51.9238, "KZ"),
    ("Костанай", 53.2198, 63.6354, "KZ"), ("Кызылорда", 44.8479, 65.4823, "KZ"),
    ("Уральск", 51.2333, 51.3667, "KZ"), ("Петропавловск", 54.8667, 69.1500, "KZ"),
    ("Актау", 43.6410, 51.1980, "KZ"), ("Москва", 55.7558, 37.6173, "RU"),
    ("Стамбул", 41.0082, 28.9784, "TR"), ("Дубай", 25.2048, 55.2708, "AE"),
    ("Бангкок", 13.7563, 100.5018, "TH"), ("Киев", 50.4501, 30.5234, "UA"),
    ("Лагос", 6.5244, 3.3792, "NG"), ("Лондон", 51.5074, -0.1278, "GB"),
    ("Бишкек", 42.8746, 74.5698, "KG"),
]
UNKNOWN_PLACE = (48.0196, 66.9237, "KZ")

# ---- fixed values: defaults of a client without a profile ---------------------------------
DEFAULT_AGE = 35
DEFAULT_HOME_CITY = "Алматы"
DEFAULT_TICKET = 12000.0
DEFAULT_TENURE_DAYS = 365
PRIOR_WEIGHT = 3.0


def places(spark: SparkSession) -> DataFrame:
    """The built-in place dimension; callers may pass any table of the same shape instead."""
    return spark.createDataFrame(PLACES, "city string, lat double, lon double, country string")

"""Canonical column names, key sets and fixed domain values."""

from __future__ import annotations

# Keys -------------------------------------------------------------------------
STORE = "store_code"
PRODUCT = "product_code"
SERIES_KEY = (STORE, PRODUCT)          # one demand series per store x product
PRODUCT_KEY = (PRODUCT,)               # daily series across stores

# Canonical transaction columns (one row per till line).
TX_COLUMNS = (
    "store_code", "product_code", "order_id", "line_no", "member_id",
    "sale_date", "sale_ts", "channel", "touchpoint", "category_code",
    "product_name", "list_price", "discount_type", "tax_rate", "qty",
    "gross_amount", "net_amount", "discount_amount",
)

# Must equal the source system's labels for correct results.
NO_DISCOUNT = "n-无折扣促销"          # discount_type of an undiscounted sale
OFFLINE_CHANNEL = "线下销售"           # store till channel
ONLINE_CHANNEL = "线上销售"            # online channel

# Weather code -> severity (2-digit codes, any other code -> 0).
WEATHER_SEVERITY = {
    "01": 0, "02": 1, "03": 2, "04": 3, "07": 4, "08": 5, "09": 6, "10": 7,
    "13": 4, "14": 5, "15": 6, "16": 7, "18": 3, "53": 4,
}
# Weather type flags from the 2-digit day code.
WEATHER_TYPE_CODES = {
    "is_sunny": ["01"],
    "is_cloudy": ["02"],
    "is_rainy": ["04", "07", "08", "09", "10"],
    "is_snowy": ["13", "14", "15", "16"],
    "is_foggy": ["18"],
    "is_haze": ["53"],
}

# Keywords marking a fresh product, and the fresh category prefix.
FRESH_KEYWORDS = ["鲜", "奶", "豆腐", "面包", "糕点", "蔬菜", "水果", "肉", "鱼", "蛋"]
FRESH_CATEGORY_PREFIX = "20"
# Shelf life in hours; dairy keywords -> 48, other fresh -> 24, others -> 168.
DAIRY_KEYWORDS = ["鲜奶", "酸奶", "豆浆"]
SHELF_LIFE_DAIRY, SHELF_LIFE_FRESH, SHELF_LIFE_OTHER = 48, 24, 168

# Pack-size patterns, tried in this order (weight, volume, size, pieces, packs).
PACK_SIZE_PATTERNS = [
    r"(\d+(\.\d+)?)[kK]?[gG]",
    r"(\d+(\.\d+)?)[mM]?[lL]",
    r"(\d+(\.\d+)?)[cC][mM]",
    r"(\d+(\.\d+)?)个",
    r"(\d+(\.\d+)?)包",
]

# Shopping festivals (month, day) and paydays (day of month).
SHOPPING_DAYS = [(6, 18), (11, 11), (12, 12)]
PAYDAYS = [15, 30]

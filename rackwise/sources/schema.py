"""Fixed schemas of the three shop tables, and the defaults a new row starts from."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from rackwise.functions.fixed_values import DEFAULT_PERCENT

_TYPES = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "date": DateType()}


def _schema(text: str) -> StructType:
    pairs = [field.split() for field in text.split(",")]
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in pairs])


CONSIGNORS = _schema(
    "id string, name string, whatsapp string, email string, pix_key string, percent double, notes string, active int"
)

ITEMS = _schema(
    "sku string, consignor_id string, acquisition_type string, category string, subcategory string, brand string,"
    "gender string, size string, fit string, color string, fabric string, condition string, flaws string,"
    "bust double, waist double, length double, cost double, list_price double, markdown_stage int,"
    "acquired_at date, listed_at date, channel_listed string, sold_at date, sale_price double, channel_sold string,"
    "days_on_hand int, photos_url string, notes string, active int"
)

SALES = _schema(
    "id string, date date, sku string, sale_price double, discount_value double, channel string,"
    "customer_name string, customer_whatsapp string, payment_method string, notes string, consignor_id string"
)

SCHEMAS = {"consignors": CONSIGNORS, "items": ITEMS, "sales": SALES}

KEYS = {"consignors": "id", "items": "sku", "sales": "id"}

# Used only where a new row does not supply the column; a supplied NULL stays NULL.
DEFAULTS = {
    "consignors": {"percent": DEFAULT_PERCENT, "active": 1},
    "items": {"cost": 0.0, "markdown_stage": 0, "active": 1},
    "sales": {"discount_value": 0.0},
}

"""The shop's tables, and batches of new rows for it, derived from a TPC-H-like star schema.

Suppliers become consignors, orders become items (described by a part), and order lines become
events on an item, by their return flag: ``N`` lines are sales, ``A`` lines a later batch of sales
to register, ``R`` lines a batch of changes to items. Every row of the source tables is used.

Prices are a thousandth of the source amounts, in cents rounded half up by whole-number arithmetic, so
that any engine derives the same cents.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rackwise.sources.schema import CONSIGNORS, ITEMS, SALES
from rackwise.sources.tables import Tables

# Order of sales within a month, unique over the source lines.
SALE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
# Order of changes to one item; the last one counts.
CHANGE_ORDER = ["changed_at", "l_partkey", "l_suppkey", "l_linenumber"]

# One number past the last supplier occurs too: a consignor that was deleted.
_ORDERS = """(
  SELECT *, CAST(o_orderdate AS DATE) AS listed_at, CAST(o_custkey % ((SELECT count(*) FROM {supplier}) + 1) + 1 AS STRING) AS owner
  FROM {orders})"""
_CONSIGNOR_OF = "concat('C', lpad(owner, greatest(4, length(owner)), '0'))"

_CONSIGNORS = """
SELECT format_string('C%04d', s_suppkey + 1) AS id,
       s_name AS name,
       CASE WHEN s_suppkey % 4 <> 0 THEN concat('31-', s_suppkey) END AS whatsapp,
       concat('pix-', s_suppkey) AS pix_key,
       CASE WHEN s_suppkey % 5 <> 0 THEN (40 + 5 * (s_suppkey % 5)) / 100 END AS percent,
       CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS active
FROM {supplier}
"""

_ITEMS = f"""
SELECT CAST(o_orderkey AS STRING) AS sku,
       CASE WHEN o_orderkey % 11 <> 0 THEN {_CONSIGNOR_OF} END AS consignor_id,
       CASE WHEN o_orderkey % 11 <> 0 THEN 'consignação' WHEN o_orderkey % 2 = 0 THEN 'doação' ELSE 'troca' END AS acquisition_type,
       CASE o_orderkey % 37 WHEN 0 THEN NULL WHEN 1 THEN 'Vestido' WHEN 2 THEN 'Bolsa' ELSE p_type END AS category,
       p_name AS subcategory,
       CASE WHEN o_orderkey % 13 <> 0 THEN p_brand END AS brand,
       CASE WHEN o_orderkey % 23 <> 0 THEN CAST(p_size AS STRING) END AS size,
       element_at(array('F', 'M', 'Unissex', 'X'), CAST(o_orderkey % 4 + 1 AS INT)) AS gender,
       element_at(array('Ajustada', 'Regular', 'Ampla', 'Larga'), CAST(o_orderkey % 4 + 1 AS INT)) AS fit,
       element_at(array('A', 'A-', 'B', 'C'), CAST(o_orderkey % 4 + 1 AS INT)) AS condition,
       0.0D AS cost,
       (floor(o_totalprice * 100 + 0.5D) + 500) div 1000 / 100 AS list_price,
       CASE WHEN o_orderkey % 6 <> 5 THEN o_orderkey % 6 END AS markdown_stage,
       listed_at AS acquired_at,
       CASE WHEN o_orderkey % 41 <> 0 THEN listed_at END AS listed_at,
       element_at(array('Loja', 'Instagram', 'WhatsApp', 'Online'), CAST(o_orderkey % 4 + 1 AS INT)) AS channel_listed,
       sold_at,
       CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN concat('photos/', o_orderkey) END AS photos_url,
       CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END AS active
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM {{part}}) AS part_no FROM {_ORDERS}) AS o
JOIN {{part}} AS p ON p_partkey = part_no
LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS sold_at
           FROM {{lineitem}} WHERE l_returnflag = 'N' AND l_partkey % 53 <> 0 GROUP BY l_orderkey) AS sold ON l_orderkey = o_orderkey
"""

_SALE_LINES = f"""
SELECT {", ".join(SALE_ORDER)}, l_tax,
       CAST(l_shipdate AS DATE) AS date,
       CASE WHEN l_partkey % 53 = 0 THEN concat('avulso-', l_orderkey) ELSE CAST(l_orderkey AS STRING) END AS sku,
       (floor(l_extendedprice * 100 + 0.5D) + 500) div 1000 / 100 AS sale_price,
       CASE WHEN l_discount > 0 THEN
         (floor(l_extendedprice * 100 + 0.5D) * floor(l_discount * 100 + 0.5D) + 50000) div 100000 / 100
       END AS discount_value,
       element_at(array('Loja', 'Instagram', 'WhatsApp', 'Online'), l_linenumber % 4 + 1) AS channel,
       element_at(array('Débito', 'Crédito', 'Pix', 'Dinheiro'), l_linenumber % 4 + 1) AS payment_method,
       CASE WHEN l_suppkey % 9 <> 0 THEN format_string('C%04d', l_suppkey + 2) END AS consignor_id
FROM {{lineitem}} WHERE l_returnflag = :flag
"""
# The number in a sale's id, from the line's own keys: room for five digits of part, four of supplier.
_SALE_NUMBER = "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber"
_SALES = f"""
SELECT *, concat('V', date_format(date, 'yyMM'), CAST({_SALE_NUMBER} AS STRING)) AS id FROM ({_SALE_LINES})
"""

# Customers who want to become consignors; those of one market segment left their name blank.
_NEW_CONSIGNORS = """
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_name END AS name,
       concat('31-', c_custkey) AS whatsapp,
       CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS active
FROM {customer}
"""

# Orders as incoming items; some lack a category, some a price, some a consignor.
_NEW_ITEMS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE format_string('C%04d', o_custkey) END AS consignor_id,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS category,
       CASE WHEN o_orderpriority = '5-LOW' THEN 0.0D
            ELSE (floor(o_totalprice * 100 + 0.5D) + 500) div 1000 / 100 END AS list_price,
       CAST(o_orderkey % 4 AS INT) AS markdown_stage,
       CAST(o_orderdate AS DATE) AS acquired_at,
       CAST(o_orderdate AS DATE) AS listed_at
FROM {orders}
"""

# By tax rate some sales lack a SKU or name an unknown one; undiscounted ones lack a price.
_NEW_SALES = f"""
SELECT * EXCEPT (sku, sale_price, date, l_tax),
       CASE WHEN l_partkey % 31 <> 0 THEN date END AS date,
       CASE WHEN l_tax < 0.005D THEN '' WHEN l_tax > 0.075D THEN concat('perdido-', sku) ELSE sku END AS sku,
       CASE WHEN discount_value IS NULL THEN 0.0D ELSE sale_price END AS sale_price
FROM ({_SALE_LINES})
"""

# Changes of price, channel and notes; lines with the highest tax rate bring new items.
_ITEM_CHANGES = """
SELECT CASE WHEN l_tax > 0.075D THEN concat('novo-', l_orderkey) WHEN l_partkey % 43 <> 0 THEN CAST(l_orderkey AS STRING) END AS sku,
       (floor(l_extendedprice * 100 + 0.5D) + 500) div 1000 / 100 AS list_price,
       element_at(array('Loja', 'Instagram', 'WhatsApp', 'Online'), l_linenumber % 4 + 1) AS channel_listed,
       CASE WHEN l_linestatus = 'O' THEN 'revisado' END AS notes,
       CAST(l_shipdate AS DATE) AS changed_at, l_partkey, l_suppkey, l_linenumber
FROM {lineitem} WHERE l_returnflag = 'R'
"""

# One file per order line below its item's folder, with endings that do and do not count.
_PHOTO_PATHS = """
SELECT concat('photos/', l_orderkey, '/',
              concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT)),
              CASE WHEN l_returnflag = 'A' THEN '.jpg' WHEN l_returnflag = 'R' THEN '.png'
                   WHEN l_linestatus = 'F' THEN '.jpeg' ELSE '.JPG' END) AS path
FROM {lineitem}
"""

_SOURCES = ("supplier", "customer", "part", "orders", "lineitem")


class SampleShop:
    """A shop over one folder of source tables. Tables are built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _query(self, sql: str, args: dict | None = None) -> DataFrame:
        paths = {name: f"{self.folder}/{name}.parquet" for name in _SOURCES if "{" + name + "}" in sql}
        read = {name: self.spark.read.parquet(path) for name, path in paths.items()}
        return self.spark.sql(sql, args=args or {}, **read)

    @cached_property
    def consignors(self) -> DataFrame:
        return _complete(self._query(_CONSIGNORS), CONSIGNORS)

    @cached_property
    def items(self) -> DataFrame:
        return _complete(self._query(_ITEMS), ITEMS)

    @cached_property
    def sales(self) -> DataFrame:
        """Sales, a narrow projection of the lines: a period's filter reaches the scan."""
        return _complete(self._query(_SALES, {"flag": "N"}), SALES)

    @cached_property
    def new_consignors(self) -> DataFrame:
        return self._query(_NEW_CONSIGNORS)

    @cached_property
    def new_items(self) -> DataFrame:
        return self._query(_NEW_ITEMS)

    @cached_property
    def new_sales(self) -> DataFrame:
        return self._query(_NEW_SALES, {"flag": "A"})

    @cached_property
    def item_changes(self) -> DataFrame:
        return self._query(_ITEM_CHANGES)

    @cached_property
    def photo_paths(self) -> DataFrame:
        return self._query(_PHOTO_PATHS)

    def tables(self) -> Tables:
        return Tables(self.consignors, self.items, self.sales)


def _complete(df: DataFrame, schema: StructType) -> DataFrame:
    """All columns of ``schema`` in its order; those that ``df`` lacks are NULL."""
    return df.selectExpr(*[
        f"CAST({f.name if f.name in df.columns else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema
    ])

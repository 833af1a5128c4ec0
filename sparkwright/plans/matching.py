"""Mapping-profile plan."""

from __future__ import annotations

from sparkwright.operators import matching as MT
from sparkwright.plans.retail import RAW as RETAIL_RAW
from sparkwright.sources import fixtures as FX

QUERIES = {
    "apply_mapping_profile": lambda s, d: MT.apply_mapping_profile(FX.retail_raw(s, d), "sales_retail",
                                                                   FX.RETAIL_MAPPING),
}

ORACLE = {
    "apply_mapping_profile": "WITH " + RETAIL_RAW + """ SELECT "InvoiceNo" AS order_id, "InvoiceDate" AS order_date,
      "CustomerID" AS customer_id, "Description" AS product_name, "Quantity" AS quantity, "UnitPrice" AS unit_price,
      "Country" AS country, "Category" AS product_category, "Status" AS invoice_status FROM retail_raw""",
}

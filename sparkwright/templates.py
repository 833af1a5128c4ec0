"""Business templates: canonical fields and column-name synonyms.

Fixed values below must equal the published template definitions for mappings, rule
selection and schema matching to agree; they are stated as plain data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- Fixed values: canonical fields per template ---------------------------------
RETAIL_REQUIRED = ["order_id", "order_date", "customer_id", "product_name", "quantity", "unit_price"]
RETAIL_OPTIONAL = ["country", "product_category", "invoice_status"]

MANUFACTURING_REQUIRED = ["timestamp", "machine_id", "actual_output", "scrap_count", "downtime_minutes"]
MANUFACTURING_OPTIONAL = ["planned_output", "runtime_minutes", "line", "shift", "product", "quality_status"]

LOGISTICS_REQUIRED = ["shipment_id", "order_date", "delivery_date", "planned_delivery_date"]
LOGISTICS_OPTIONAL = ["carrier", "origin", "destination", "shipping_cost", "delivery_status"]

FINANCE_REQUIRED = ["transaction_id", "date", "amount", "type"]
FINANCE_OPTIONAL = ["category", "account", "cost_center", "budget", "actual"]

# ---- Fixed values: synonyms per field, in preference order ------------------------
RETAIL_SYNONYMS = {
    "order_id": ["order_id", "invoice_no", "invoice", "order", "transaction_id"],
    "order_date": ["order_date", "invoice_date", "date", "timestamp"],
    "customer_id": ["customer_id", "customer", "client_id", "user_id"],
    "product_name": ["product_name", "description", "item", "product"],
    "quantity": ["quantity", "qty", "units", "amount"],
    "unit_price": ["unit_price", "price", "sales_price", "item_price"],
    "country": ["country", "region", "market"],
    "product_category": ["product_category", "category", "department", "segment"],
    "invoice_status": ["invoice_status", "status", "order_status"],
}
MANUFACTURING_SYNONYMS = {
    "timestamp": ["timestamp", "date", "datetime", "production_date", "event_time", "shift_date"],
    "machine_id": ["machine_id", "machine", "asset_id", "equipment_id", "work_center", "station"],
    "actual_output": ["actual_output", "output", "units_produced", "produced_units", "good_units"],
    "scrap_count": ["scrap_count", "scrap", "defects", "defect_count", "rejected_units"],
    "downtime_minutes": ["downtime_minutes", "downtime", "down_minutes", "stoppage_minutes"],
    "planned_output": ["planned_output", "target_output", "planned_units", "target_units"],
    "runtime_minutes": ["runtime_minutes", "runtime", "run_minutes", "operating_minutes"],
    "line": ["line", "production_line", "cell", "area"],
    "shift": ["shift", "shift_name", "crew"],
    "product": ["product", "sku", "item", "part_number"],
    "quality_status": ["quality_status", "status", "inspection_status"],
}
LOGISTICS_SYNONYMS = {
    "shipment_id": ["shipment_id", "shipment", "tracking_id", "consignment_id"],
    "order_date": ["order_date", "ship_date", "dispatch_date", "date"],
    "delivery_date": ["delivery_date", "delivered_at", "arrival_date"],
    "planned_delivery_date": ["planned_delivery_date", "promised_date", "expected_delivery_date", "due_date"],
    "carrier": ["carrier", "shipping_provider", "courier"],
    "origin": ["origin", "ship_from", "warehouse"],
    "destination": ["destination", "ship_to", "market"],
    "shipping_cost": ["shipping_cost", "freight_cost", "cost"],
    "delivery_status": ["delivery_status", "status", "shipment_status"],
}
FINANCE_SYNONYMS = {
    "transaction_id": ["transaction_id", "transaction", "entry_id", "journal_id"],
    "date": ["date", "transaction_date", "posting_date", "timestamp"],
    "amount": ["amount", "value", "transaction_amount"],
    "type": ["type", "transaction_type", "revenue_cost_flag", "entry_type"],
    "category": ["category", "expense_category", "revenue_category"],
    "account": ["account", "account_name", "ledger_account"],
    "cost_center": ["cost_center", "department", "business_unit"],
    "budget": ["budget", "planned", "budget_amount"],
    "actual": ["actual", "actual_amount", "realized_amount"],
}

# ---- Fixed values: finance type vocabulary ----------------------------------------
REVENUE_TYPES = ["revenue", "income", "sales"]
COST_TYPES = ["cost", "expense", "spend", "cogs"]


@dataclass(frozen=True)
class Template:
    template_id: str
    name: str
    required: list[str]
    optional: list[str]
    synonyms: dict[str, list[str]] = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        return self.required + self.optional


# Template ids and display names.
TEMPLATES: dict[str, Template] = {
    "sales_retail": Template("sales_retail", "Sales / Retail Analytics", RETAIL_REQUIRED, RETAIL_OPTIONAL,
                             RETAIL_SYNONYMS),
    "manufacturing": Template("manufacturing", "Manufacturing Analytics", MANUFACTURING_REQUIRED,
                              MANUFACTURING_OPTIONAL, MANUFACTURING_SYNONYMS),
    "logistics": Template("logistics", "Logistics Analytics", LOGISTICS_REQUIRED, LOGISTICS_OPTIONAL,
                          LOGISTICS_SYNONYMS),
    "finance": Template("finance", "Finance Analytics", FINANCE_REQUIRED, FINANCE_OPTIONAL, FINANCE_SYNONYMS),
}

# Template labels used in quality-rule output.
RULE_TEMPLATE_LABELS = {
    "sales_retail": "Sales / Retail",
    "manufacturing": "Manufacturing",
    "logistics": "Logistics",
    "finance": "Finance",
}


def get_template(template_id: str) -> Template:
    if template_id not in TEMPLATES:
        raise ValueError(f"Unknown template: {template_id}")
    return TEMPLATES[template_id]

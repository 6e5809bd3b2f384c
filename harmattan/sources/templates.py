"""Import templates: required columns, keys, aliases and business rules per kind of export."""

from __future__ import annotations

# The five export kinds understood at import.
TEMPLATES = {
    "erp_sales_export": {
        "label": "ERP Sales Export",
        "required_columns": ["document_no", "customer_code", "document_date", "amount", "currency"],
        "key_columns": ["document_no"],
        "column_aliases": {
            "document_no": ["document_no", "doc_no", "invoice_no", "invoice_number", "document number"],
            "customer_code": ["customer_code", "customer", "customer_id", "client_code", "client"],
            "document_date": ["document_date", "date", "invoice_date", "posting_date"],
            "amount": ["amount", "net_amount", "total_amount", "value"],
            "currency": ["currency", "currency_code", "devise"],
        },
        "business_rules": [
            {"type": "required_non_empty", "column": "document_no", "severity": "error"},
            {"type": "required_non_empty", "column": "customer_code", "severity": "error"},
            {"type": "required_non_empty", "column": "document_date", "severity": "error"},
            {"type": "positive_number", "column": "amount", "severity": "warning"},
            {"type": "allowed_values", "column": "currency", "values": ["USD", "EUR", "XOF", "GBP"], "severity": "warning"},
            {"type": "date_parseable", "column": "document_date", "severity": "warning"},
        ],
    },
    "erp_inventory_export": {
        "label": "ERP Inventory Export",
        "required_columns": ["sku", "warehouse_code", "stock_quantity"],
        "key_columns": ["sku", "warehouse_code"],
        "column_aliases": {
            "sku": ["sku", "item_code", "product_code", "article"],
            "warehouse_code": ["warehouse_code", "warehouse", "depot", "store_code"],
            "stock_quantity": ["stock_quantity", "quantity", "qty", "on_hand"],
            "stock_value": ["stock_value", "inventory_value", "value"],
        },
        "business_rules": [
            {"type": "required_non_empty", "column": "sku", "severity": "error"},
            {"type": "required_non_empty", "column": "warehouse_code", "severity": "error"},
            {"type": "non_negative_number", "column": "stock_quantity", "severity": "warning"},
            {"type": "non_negative_number", "column": "stock_value", "severity": "warning"},
        ],
    },
    "erp_customer_master": {
        "label": "ERP Customer Master",
        "required_columns": ["customer_code", "customer_name", "country"],
        "key_columns": ["customer_code"],
        "column_aliases": {
            "customer_code": ["customer_code", "customer", "customer_id", "client_code"],
            "customer_name": ["customer_name", "customer_label", "client_name", "name"],
            "country": ["country", "country_code", "pays"],
            "status": ["status", "state", "customer_status"],
        },
        "business_rules": [
            {"type": "required_non_empty", "column": "customer_code", "severity": "error"},
            {"type": "required_non_empty", "column": "customer_name", "severity": "error"},
            {"type": "allowed_values", "column": "status", "values": ["active", "inactive", "prospect"], "severity": "warning", "case_insensitive": True},
        ],
    },
    "erp_supplier_master": {
        "label": "ERP Supplier Master",
        "required_columns": ["supplier_code", "supplier_name", "country"],
        "key_columns": ["supplier_code"],
        "column_aliases": {
            "supplier_code": ["supplier_code", "vendor_code", "supplier", "vendor"],
            "supplier_name": ["supplier_name", "vendor_name", "name"],
            "country": ["country", "country_code", "pays"],
            "payment_terms": ["payment_terms", "terms", "payment_term"],
        },
        "business_rules": [
            {"type": "required_non_empty", "column": "supplier_code", "severity": "error"},
            {"type": "required_non_empty", "column": "supplier_name", "severity": "error"},
        ],
    },
    "erp_gl_entries": {
        "label": "ERP GL Entries",
        "required_columns": ["entry_no", "account_code", "posting_date", "debit", "credit"],
        "key_columns": ["entry_no", "account_code"],
        "column_aliases": {
            "entry_no": ["entry_no", "journal_no", "piece_no", "entry_number"],
            "account_code": ["account_code", "gl_account", "account", "compte"],
            "posting_date": ["posting_date", "date", "entry_date"],
            "debit": ["debit", "debit_amount"],
            "credit": ["credit", "credit_amount"],
            "currency": ["currency", "currency_code", "devise"],
        },
        "business_rules": [
            {"type": "required_non_empty", "column": "entry_no", "severity": "error"},
            {"type": "required_non_empty", "column": "account_code", "severity": "error"},
            {"type": "date_parseable", "column": "posting_date", "severity": "warning"},
            {"type": "non_negative_number", "column": "debit", "severity": "warning"},
            {"type": "non_negative_number", "column": "credit", "severity": "warning"},
        ],
    },
}

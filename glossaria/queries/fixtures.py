"""Small literal tables that both engines get: fields, a glossary, vocabularies.

``frame`` makes a DataFrame, ``values`` the same rows as a SQL relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaria.functions.constants import ABBREVIATIONS, CATEGORY_MATRIX, DOMAINS, TYPE_CATEGORIES, TYPE_MATRIX

#: (schema, path, type, description, is_array, declared domain); keys and ordinals follow.
_FIELDS = [
    ("tpch", "region.r_regionkey", "integer", "", False, ""),
    ("tpch", "region.r_name", "string", "name of the region", False, ""),
    ("tpch", "nation.n_nationkey", "integer", "", False, ""),
    ("tpch", "nation.n_name", "string", "", False, "COUNTRY"),
    ("tpch", "nation.n_regionkey", "integer", "region of the nation", False, ""),
    ("tpch", "customer.c_custkey", "long", "customer identifier", False, ""),
    ("tpch", "customer.c_name", "string", "", False, ""),
    ("tpch", "customer.c_nationkey", "integer", "", False, ""),
    ("tpch", "customer.c_acctbal", "double", "account balance of the customer", False, ""),
    ("tpch", "customer.c_mktsegment", "string", "market segment", False, ""),
    ("tpch", "supplier.s_suppkey", "long", "", False, ""),
    ("tpch", "supplier.s_name", "string", "", False, ""),
    ("tpch", "supplier.s_acctbal", "double", "", False, ""),
    ("tpch", "part.p_partkey", "long", "", False, ""),
    ("tpch", "part.p_retailprice", "decimal", "retail price", False, "PRODUCT"),
    ("tpch", "orders.o_orderkey", "long", "", False, ""),
    ("tpch", "orders.o_totalprice", "double", "total price of the order", False, ""),
    ("tpch", "orders.o_orderdate", "timestamp", "order date", False, ""),
    ("tpch", "lineitem.l_quantity", "double", "quantity", False, ""),
    ("tpch", "lineitem.l_extendedprice", "double", "", False, ""),
    ("tpch", "lineitem.l_shipdate", "date", "date of shipping", False, ""),
    ("bank", "com.example.customer.contact.emailAddress", "string", "where to write to", False, ""),
    ("bank", "com.example.customer.contact.phoneNumber", "string", "", True, ""),
    ("bank", "customer.acctBal", "decimal", "", False, ""),
    ("bank", "customer.custAddr", "record", "", False, ""),
    ("bank", "customer.KYCStatus", "enum", "", False, ""),
    ("bank", "account.txn.txnAmt", "decimal", "transaction amount", False, ""),
    ("bank", "account.txn.txn_dt", "date", "", False, ""),
    ("bank", "account.txn.txn_dt", "timestamp", "second of that path", False, ""),
    ("bank", "account.tags", "string", "", True, ""),
    ("bank", "payment.pmt_id", "uuid", "", False, ""),
    ("bank", "payment.pmt_ref2", "string", "", False, ""),
    ("bank", "id", "long", "", False, ""),
    ("bank", "HTTPServerURL", "string", "", False, ""),
    ("bank", "a.b.cd.e1.f_g.h_i.j_k.deepLeaf", "json", "", False, ""),
    ("bank", "CUST_ACCT__BAL_AMT", "double", "", False, ""),
    ("bank", "loan.int_rt_pct", "float", "interest rate percent", False, "LOANS"),
    ("bank", "mortgage.mo_pmt_amt", "double", "", False, ""),
]
FIELDS = [(i, f"{s}:{i}", s, p.rsplit(".", 1)[-1], p, p.rsplit(".", 1)[0] if "." in p else "", t, d, a, dom) for i, (s, p, t, d, a, dom) in enumerate(_FIELDS)]
FIELD_COLUMNS = "ordinal int, field_key string, schema_name string, name string, full_path string, parent_path string, data_type string, description string, is_array boolean, declared_domain string"

#: (business name, logical name, definition, type, domain, status, code, classification, personal, direct)
_GLOSSARY = [
    ("Customer Identifier", "customer_identifier", "Identifies a customer.", "bigint", "CUSTOMER", "Approved", "P3", "Confidential", "yes", "no"),
    ("Customer Name", "customer_name", "Full name of a customer.", "varchar(100)", "IDENTITY", "Approved", "P4", "Restricted", "yes", "yes"),
    ("Customer Account Balance", "customer_account_balance", "Balance of a customer's account.", "decimal(18,2)", "BALANCES", "Approved", "P3", "Confidential", "no", "no"),
    ("Account Balance", "account_balance", "Balance of an account.", "decimal(18,2)", "BALANCES", "approved ", "p-3", "confidential", "no", "no"),
    ("Account Number", "account_number", "Number of an account.", "string", "ACCOUNTS", "Approved", "P3", "Confidential", "no", "yes"),
    ("Transaction Amount", "transaction_amount", "Amount of a transaction.", "decimal", "TRANSACTIONS", "Approved", "P2", "Internal", "no", "no"),
    ("Transaction Date", "transaction_date", "Day of a transaction.", "date", "TRANSACTIONS", "Approved", "P2", "Internal", "no", "no"),
    ("Transaction Timestamp", "transaction_timestamp", "Moment of a transaction.", "timestamp", "TRANSACTIONS", "Retired", "P2", "Public", "no", "no"),
    ("Email Address", "email_address", "Where to write to a customer.", "text", "EMAIL", "Approved", "PII", "Restricted", "yes", "yes"),
    ("Phone Number", "phone_number", "Telephone number of a customer.", "string", "PHONE", "Approved", "PII", "Restricted", "true", "1"),
    ("Postal Address", "customer_address", "Address of a customer.", "record", "ADDRESS", "Approved", "P4", "Restricted", "yes", "no"),
    ("KYC Status", "kyc_status", "State of the customer check.", "enum", "KYC", "Approved", "P2", "Internal", "no", "no"),
    ("Payment Identifier", "payment_identifier", "Identifies a payment.", "uuid", "PAYMENTS", "Approved", "P2", "Internal", "no", "no"),
    ("Payment Reference", "payment_reference", "Reference of a payment.", "string", "PAYMENTS", "Draft", "X9", "Internal", "no", "no"),
    ("Payment Amount", "payment_amount", "Amount of a payment.", "numeric(12,2)", "PAYMENTS", "Approved", "", "", "", ""),
    ("Interest Rate Percent", "interest_rate_percent", "Interest of a loan in percent.", "float", "LOANS", "Approved", "P1", "Public", "no", "no"),
    ("Monthly Payment Amount", "monthly_payment_amount", "Amount paid for a mortgage each month.", "double", "MORTGAGES", "Approved", "P2", "Internal", "no", "no"),
    ("Order Date", "order_date", "Day on which an order was made.", "date", "PRODUCT", "Approved", "P1", "Public", "no", "no"),
    ("Order Total Price", "order_total_price", "Total price of an order.", "double", "PRODUCT", "Approved", "P1", "public", "no", "no"),
    ("Order Key", "order_key", "Identifies an order.", "long", "PRODUCT", "Approved", "P1", "Public", "no", "no"),
    ("Retail Price", "retail_price", "Price of a part.", "decimal", "PRODUCT", "Approved", "P1", "Public", "no", "no"),
    ("Extended Price", "extended_price", "Price of a line.", "double", "PRODUCT", "Approved", "OPEN", "Public", "no", "no"),
    ("Quantity", "quantity", "Number of pieces.", "double", "PRODUCT", "Approved", "NONE", "", "no", "no"),
    ("Ship Date", "ship_date", "Date of shipping.", "date", "PRODUCT", "Approved", "P1", "Public", "no", "no"),
    ("Region Name", "region_name", "Name of a region.", "string", "GEOGRAPHY", "Approved", "P1", "Public", "no", "no"),
    ("Region Key", "region_key", "Identifies a region.", "integer", "GEOGRAPHY", "Approved", "P1", "Public", "no", "no"),
    ("Nation Name", "nation_name", "Name of a nation.", "string", "COUNTRY", "Approved", "P1", "Public", "no", "no"),
    ("Nation Key", "nation_key", "Identifies a nation.", "integer", "COUNTRY", "Approved", "P1", "Public", "no", "no"),
    ("Supplier Name", "supplier_name", "Name of a supplier.", "string", "", "Approved", "P1", "Public", "no", "no"),
    ("Supplier Account Balance", "supplier_account_balance", "Balance of a supplier's account.", "double", "", "Approved", "P2", "Internal", "no", "no"),
    ("Market Segment", "market_segment", "Segment of the market.", "string", "PREFERENCES", "Approved", "P1", "Public", "no", "no"),
    ("Market Segment", "market_segment", "Segment of the market.", "string", "PREFERENCES", "Approved", "P1", "Public", "no", "no"),
    ("Market Segment", "market_segment", "Segment of the market.", "string", "PREFERENCES", "Retired", "P1", "Public", "no", "no"),
    ("Server Address", "http_server_url", "Address of a server.", "string", "SYSTEM", "Approved", "P2", "Internal", "no", "no"),
    ("Description", "description", "Free text.", "text", "", "Approved", "P1", "Internal", "no", "no"),
    ("Name", "name", "", "string", "", "Approved", "P1", "Public", "no", "no"),
    ("", "", "", "string", "", "Approved", "P1", "Public", "no", "no"),
    ("", "orphan_code", "A definition without a name.", "int", "", "Draft", "P1", "Public", "no", "no"),
    ("Credit Card Number", "credit_card_number", "Number of a card.", "string", "CARDS", "Approved", "P4", "Internal", "yes", "no"),
    ("Account Opening Date", "account_opening_date", "Day on which an account was opened.", "datetime", "ACCOUNTS", "Approved", "P2", "Internal", "no", "no"),
]
GLOSSARY = [(i, f"T-{i:03d}", *row) for i, row in enumerate(_GLOSSARY)]
GLOSSARY_COLUMNS = "ordinal int, id string, business_name string, logical_name string, definition string, data_type string, domain string, status string, code string, classification string, personal string, direct string"

CLASSES = [("P1", "Open data", "Public", False, False), ("P2", "Business data", "Internal", False, False), ("P3", "Customer data", "Confidential", True, False), ("P4", "Personal data", "Restricted", True, True)]
ALIASES = [("PII", "P4"), ("OPEN", "P1"), ("NONE", None)]

TYPE_NAMES = ["VARCHAR(20)", "text", "bigint", "int64", "INTERVAL", "decimal(10,2)", "NUMBER", "double precision", "float8", "bit", "date", "datetime2", "timestamp with time zone", "time", "bytea", "varbinary(8)", "array<string>", "list", "record", "enum", "uuid", "uniqueidentifier", "jsonb", "map<string,int>", "fixed", "tinyint", "NCHAR(3)", "MEDIUMINT", "BIGSERIAL", "timestamp-micros", "boolean", "", "point", "longtext", " Integer ", "null"]
PROTECTION_TEXTS = ["Public", "Non-Public", "NPI - Nonpublic", "Unrestricted", "restricted / internal", "Highly Confidential", "PII", "no_pii", "personal data", "Sensitive", "open", "opening", "", "secret-ish", "Internal Use Only", "not for public release", "phi", "graphics", "un_restricted"]
FLAGS = ["true", "Yes", " y ", "1", "T", "false", "NO", "n", "0", "f", "maybe", "", "2"]
HEADERS = ["Term ID", "Business Name", "Logical-Name", "Description", "SQL Type", "Subject Area", "Owner", "name", "Protection Class", "Sensitivity", "Doc", "Key"]
EXPANSIONS = ["acct", "cust_acct_bal", "customer_account", "", "custAcctBal", "CUST_ACCT", "Txn-Amt", "cust bal amt", "xfer", "qty", "Dt", "orderQty", "unknown_word", "src-sys-cd"]


def _grid(matrix: dict[str, dict[str, float]]) -> list[tuple[str, str, float]]:
    return [(a, b, v) for a, row in matrix.items() for b, v in row.items()]


TABLES: dict[str, tuple[str, list[tuple]]] = {
    "lit_fields": (FIELD_COLUMNS, FIELDS),
    "lit_glossary": (GLOSSARY_COLUMNS, GLOSSARY),
    "lit_classes": ("code string, name string, classification string, personal_information boolean, direct_identifier boolean", CLASSES),
    "lit_aliases": ("token string, target string", ALIASES),
    "lit_abbrev": ("short string, long string", list(ABBREVIATIONS.items())),
    "lit_domains": ("name string, parent string", list(DOMAINS)),
    "lit_types": ("type_name string", [(t,) for t in TYPE_NAMES]),
    "lit_protection": ("text string", [(t,) for t in PROTECTION_TEXTS]),
    "lit_flags": ("text string", [(t,) for t in FLAGS]),
    "lit_headers": ("ordinal int, header string", list(enumerate(HEADERS))),
    "lit_expansions": ("text string", [(t,) for t in EXPANSIONS]),
    "lit_matrix": ("src string, dst string, score double", _grid(TYPE_MATRIX)),
    "lit_category_of": ("type_name string, category string", list(TYPE_CATEGORIES.items())),
    "lit_categories": ("src string, dst string, score double", _grid(CATEGORY_MATRIX)),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = TABLES[name]
    return spark.createDataFrame(rows, columns)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(name: str) -> str:
    """``name AS (SELECT ... FROM (VALUES ...))`` for a WITH clause."""
    columns, rows = TABLES[name]
    kinds = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    named = [c.split(" ") for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in rows)
    picks = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in named)
    return f"{name} AS (SELECT {picks} FROM (VALUES {body}) AS t({', '.join(c for c, _ in named)}))"


def with_tables(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(values(n) for n in names)

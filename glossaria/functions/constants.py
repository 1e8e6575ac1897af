"""Fixed vocabularies of the matching semantics."""

from __future__ import annotations

# The type names.
TYPES = ("string", "integer", "long", "float", "double", "boolean", "date", "timestamp", "bytes", "array", "record", "enum", "uuid", "json", "decimal", "unknown")

# Abbreviations and their expansions.
ABBREVIATIONS = {
    "acct": "account", "amt": "amount", "bal": "balance", "curr": "current", "pct": "percent", "txn": "transaction", "xfer": "transfer",
    "cust": "customer", "clnt": "client", "org": "organization", "corp": "corporate", "bus": "business", "emp": "employee",
    "addr": "address", "cd": "code", "cnt": "count", "desc": "description", "dt": "date", "id": "identifier", "ind": "indicator", "msg": "message", "nm": "name", "no": "number", "num": "number", "qty": "quantity", "seq": "sequence", "stat": "status", "ts": "timestamp", "typ": "type", "val": "value",
    "yr": "year", "mo": "month", "dy": "day", "hr": "hour", "sec": "second",
    "actv": "active", "inactv": "inactive", "pend": "pending", "appr": "approved", "rej": "rejected",
    "cntry": "country", "st": "state", "cty": "city", "zip": "zipcode", "rgn": "region",
    "src": "source", "tgt": "target", "dest": "destination", "cfg": "configuration", "sys": "system", "env": "environment", "ref": "reference", "ver": "version", "fmt": "format", "len": "length", "sz": "size", "max": "maximum", "min": "minimum", "avg": "average", "tot": "total", "flg": "flag", "lvl": "level", "grp": "group", "cat": "category",
    "fst": "first", "lst": "last", "mid": "middle", "pref": "prefix", "suf": "suffix",
    "tel": "telephone", "ph": "phone", "eml": "email", "fax": "facsimile",
}

# Contractions of business words, used for aliases.
CONTRACTIONS = {
    "account": "acct", "address": "addr", "amount": "amt", "average": "avg", "balance": "bal", "category": "cat", "city": "cty", "code": "cd", "condition": "cond", "count": "cnt", "country": "cntry", "county": "cnty", "customer": "cust",
    "date": "dt", "datetime": "dttm", "department": "dept", "description": "desc", "district": "dist", "email": "eml", "enrollment": "enroll", "grade": "gr", "identifier": "id", "maximum": "max", "measurement": "meas", "minimum": "min", "month": "mo",
    "name": "nm", "number": "num", "observation": "obs", "organization": "org", "payment": "pmt", "percent": "pct", "person": "prsn", "procedure": "proc", "product": "prod", "provider": "prov", "quantity": "qty", "reading": "read", "reference": "ref",
    "school": "sch", "score": "scr", "source": "src", "state": "st", "student": "stu", "teacher": "tchr", "telephone": "tel", "test": "tst", "timestamp": "ts", "total": "tot", "transaction": "txn", "value": "val", "visit": "vis", "year": "yr",
}

# Words without content, and path segments that are name spaces.
STOPWORDS = ("of", "the", "a", "an", "in", "on", "at", "for", "to", "and", "or", "by", "with")
NAMESPACES = ("com", "org", "net", "io", "ai", "gov", "edu")

# Phrases for types.
TYPE_PHRASES = {
    "string": "text", "integer": "integer number", "long": "long integer", "float": "decimal number", "double": "decimal number", "decimal": "decimal number", "boolean": "boolean flag", "date": "date",
    "timestamp": "timestamp", "bytes": "binary data", "uuid": "unique identifier", "array": "array", "record": "record", "enum": "enumeration", "json": "json data", "unknown": "data",
}

# The domain a path or a name implies; the first that is contained decides.
PATH_DOMAINS = (
    ("account", "ACCOUNTS"), ("transaction", "TRANSACTIONS"), ("txn", "TRANSACTIONS"), ("balance", "BALANCES"), ("customer", "CUSTOMER"), ("cust", "CUSTOMER"), ("payment", "PAYMENTS"), ("card", "CARDS"), ("loan", "LOANS"),
    ("mortgage", "MORTGAGES"), ("address", "ADDRESS"), ("contact", "CONTACT"), ("phone", "PHONE"), ("email", "EMAIL"), ("product", "PRODUCT"), ("compliance", "COMPLIANCE"), ("kyc", "KYC"), ("aml", "AML"),
)
NAME_DOMAINS = (
    ("acct", "ACCOUNTS"), ("account", "ACCOUNTS"), ("txn", "TRANSACTIONS"), ("transaction", "TRANSACTIONS"), ("bal", "BALANCES"), ("balance", "BALANCES"), ("cust", "CUSTOMER"), ("customer", "CUSTOMER"),
    ("addr", "ADDRESS"), ("address", "ADDRESS"), ("payment", "PAYMENTS"), ("pmt", "PAYMENTS"),
)

# The default domain tree, as (name, parent). A name that occurs twice has its later parent.
DOMAINS = (
    ("FINANCE", None), ("BANKING", "FINANCE"), ("ACCOUNTS", "BANKING"), ("TRANSACTIONS", "BANKING"), ("BALANCES", "BANKING"), ("STATEMENTS", "BANKING"),
    ("PAYMENTS", "FINANCE"), ("TRANSFERS", "PAYMENTS"), ("WIRES", "PAYMENTS"), ("ACH", "PAYMENTS"), ("CHECKS", "PAYMENTS"),
    ("LENDING", "FINANCE"), ("LOANS", "LENDING"), ("MORTGAGES", "LENDING"), ("CREDIT_LINES", "LENDING"), ("CARDS", "FINANCE"), ("DEBIT", "CARDS"), ("PREPAID", "CARDS"),
    ("CUSTOMER", None), ("IDENTITY", "CUSTOMER"), ("VERIFICATION", "IDENTITY"), ("CONTACT", "CUSTOMER"), ("ADDRESS", "CONTACT"), ("PHONE", "CONTACT"), ("EMAIL", "CONTACT"), ("PREFERENCES", "CUSTOMER"), ("RELATIONSHIPS", "CUSTOMER"),
    ("PRODUCT", None), ("DEPOSIT", "PRODUCT"), ("CHECKING", "DEPOSIT"), ("SAVINGS", "DEPOSIT"), ("CD", "DEPOSIT"), ("MONEY_MARKET", "DEPOSIT"), ("CREDIT", "PRODUCT"), ("CREDIT_CARD", "CREDIT"), ("LINE_OF_CREDIT", "CREDIT"),
    ("INVESTMENT", "PRODUCT"), ("BROKERAGE", "INVESTMENT"), ("RETIREMENT", "INVESTMENT"), ("COMPLIANCE", None), ("KYC", "COMPLIANCE"), ("AML", "COMPLIANCE"), ("REGULATORY", "COMPLIANCE"), ("FRAUD", "COMPLIANCE"),
    ("OPERATIONS", None), ("AUDIT", "OPERATIONS"), ("SYSTEM", "OPERATIONS"), ("LOGGING", "OPERATIONS"), ("REFERENCE", None), ("GEOGRAPHY", "REFERENCE"), ("COUNTRY", "GEOGRAPHY"), ("STATE", "GEOGRAPHY"), ("CITY", "GEOGRAPHY"), ("CURRENCY", "REFERENCE"), ("CODES", "REFERENCE"),
)
RELATION_SCORES = {"EXACT": 1.0, "PARENT": 0.85, "CHILD": 0.80, "SIBLING": 0.70, "COUSIN": 0.50, "UNRELATED": 0.25}
UNKNOWN_DOMAIN_SCORE = 0.5

# Directed type compatibility, by source type.
TYPE_MATRIX = {
    "integer": {"long": 0.95, "float": 0.90, "double": 0.90, "decimal": 0.85, "string": 0.35, "boolean": 0.35, "unknown": 0.40},
    "long": {"integer": 0.75, "float": 0.85, "double": 0.90, "decimal": 0.85, "string": 0.35},
    "float": {"integer": 0.70, "long": 0.70, "double": 0.95, "decimal": 0.80, "string": 0.35},
    "double": {"integer": 0.65, "long": 0.70, "float": 0.75, "decimal": 0.80, "string": 0.35},
    "decimal": {"integer": 0.65, "long": 0.70, "float": 0.70, "double": 0.75, "string": 0.40},
    "date": {"timestamp": 0.85, "string": 0.50},
    "timestamp": {"date": 0.70, "string": 0.50},
    "string": {"integer": 0.25, "long": 0.25, "float": 0.25, "double": 0.25, "decimal": 0.30, "boolean": 0.35, "date": 0.40, "timestamp": 0.40, "unknown": 0.45, "bytes": 0.30, "uuid": 0.70, "enum": 0.60},
    "boolean": {"integer": 0.40, "long": 0.40, "string": 0.45},
    "unknown": {"string": 0.50, "integer": 0.45},
    "array": {"json": 0.60, "record": 0.20},
    "record": {"json": 0.70, "array": 0.20},
    "json": {"array": 0.55, "record": 0.65},
    "bytes": {"string": 0.30},
    "uuid": {"string": 0.90},
    "enum": {"string": 0.85},
}
TYPE_CATEGORIES = {
    "integer": "numeric", "long": "numeric", "float": "numeric", "double": "numeric", "decimal": "numeric", "string": "string", "date": "temporal", "timestamp": "temporal", "boolean": "boolean", "bytes": "binary",
    "array": "complex", "record": "complex", "json": "complex", "enum": "string", "uuid": "string", "unknown": "null",
}
CATEGORY_MATRIX = {
    "numeric": {"numeric": 0.70, "string": 0.30, "boolean": 0.35, "binary": 0.15, "complex": 0.10, "null": 0.45},
    "string": {"string": 0.90, "numeric": 0.25, "temporal": 0.35, "boolean": 0.30, "binary": 0.25, "complex": 0.15, "null": 0.50},
    "temporal": {"temporal": 0.75, "string": 0.45, "binary": 0.10, "complex": 0.15, "null": 0.45},
    "boolean": {"numeric": 0.35, "string": 0.40, "binary": 0.10, "complex": 0.10, "null": 0.45},
    "binary": {"string": 0.25, "numeric": 0.15, "boolean": 0.10, "temporal": 0.10, "complex": 0.15, "null": 0.40},
    "complex": {"complex": 0.30, "binary": 0.15, "string": 0.20, "numeric": 0.10, "boolean": 0.10, "temporal": 0.15, "null": 0.40},
    "null": {"string": 0.50, "numeric": 0.45, "boolean": 0.45, "temporal": 0.45, "binary": 0.40, "complex": 0.40},
}
DEFAULT_TYPE_SCORE = 0.5
LEVELS = ((1.0, "exact"), (0.95, "equivalent"), (0.80, "compatible"), (0.50, "convertible"), (0.0, "incompatible"))

# Type words of the four coercions.
FROM_STRING = (  # (all of these are contained..., and none of these) in order
    (("string",), (), "string"), (("char",), (), "string"), (("text",), (), "string"), (("int",), ("long", "big"), "integer"), (("long",), (), "long"), (("bigint",), (), "long"), (("float",), (), "float"),
    (("double",), (), "double"), (("decimal",), (), "double"), (("numeric",), (), "double"), (("number",), (), "double"), (("bool",), (), "boolean"), (("bit",), (), "boolean"), (("date",), ("time",), "date"), (("time",), (), "timestamp"),
    (("bytes",), (), "bytes"), (("binary",), (), "bytes"), (("blob",), (), "bytes"), (("array",), (), "array"), (("list",), (), "array"), (("[]",), (), "array"), (("record",), (), "record"), (("struct",), (), "record"), (("object",), (), "record"),
    (("enum",), (), "enum"), (("uuid",), (), "uuid"), (("json",), (), "json"),
)
GLOSSARY_TYPES = {
    "string": "string", "str": "string", "text": "string", "varchar": "string", "char": "string", "nvarchar": "string", "int": "integer", "integer": "integer", "smallint": "integer", "bigint": "long", "long": "long", "float": "float", "real": "float",
    "double": "double", "decimal": "decimal", "numeric": "decimal", "bool": "boolean", "boolean": "boolean", "bit": "boolean", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "uuid": "uuid", "json": "json", "bytes": "bytes",
}
AVRO_TYPES = {
    "string": "string", "bytes": "bytes", "int": "integer", "long": "long", "float": "float", "double": "double", "boolean": "boolean", "null": "unknown", "record": "record", "enum": "enum", "array": "array", "map": "json", "fixed": "bytes", "decimal": "decimal", "date": "date",
    "timestamp-millis": "timestamp", "timestamp-micros": "timestamp", "uuid": "uuid", "integer": "integer", "bigint": "long", "smallint": "integer", "varchar": "string", "text": "string", "char": "string", "numeric": "decimal", "real": "float", "bool": "boolean", "datetime": "timestamp", "timestamp": "timestamp", "json": "json",
}
DDL_TYPES = (  # prefix patterns on the upper-cased type, in order
    (r"(?:VAR)?CHAR", "string"), (r"N?VARCHAR", "string"), (r"TEXT", "string"), (r"CLOB", "string"), (r"BIGINT", "long"), (r"(?:SMALL|TINY)?INT(?:EGER)?", "integer"), (r"SERIAL", "integer"), (r"BIGSERIAL", "long"),
    (r"DOUBLE", "double"), (r"FLOAT", "float"), (r"REAL", "float"), (r"(?:DECIMAL|NUMERIC|NUMBER)", "decimal"), (r"BOOL", "boolean"), (r"BIT", "boolean"), (r"TIMESTAMP", "timestamp"), (r"DATETIME", "timestamp"), (r"TIME", "timestamp"), (r"DATE", "date"),
    (r"BYTEA", "bytes"), (r"BLOB", "bytes"), (r"(?:VAR)?BINARY", "bytes"), (r"IMAGE", "bytes"), (r"JSON", "json"), (r"UUID", "uuid"), (r"UNIQUEIDENTIFIER", "uuid"), (r"ARRAY", "array"),
)

# Protection levels by words of a classification; negations come first.
PROTECTION_WORDS = (
    ("nonpublic", "CONFIDENTIAL"), ("non public", "CONFIDENTIAL"), ("not for public", "CONFIDENTIAL"), ("npi", "CONFIDENTIAL"), ("unrestricted", "PUBLIC"), ("un restricted", "PUBLIC"), ("not pii", "INTERNAL"), ("no pii", "INTERNAL"), ("non pii", "INTERNAL"),
    ("restricted", "RESTRICTED"), ("secret", "RESTRICTED"), ("highly confidential", "RESTRICTED"), ("pii", "PII"), ("personal", "PII"), ("phi", "PII"), ("sensitive", "CONFIDENTIAL"), ("confidential", "CONFIDENTIAL"), ("internal", "INTERNAL"), ("public", "PUBLIC"), ("open", "PUBLIC"),
)
DEFAULT_PROTECTION = "INTERNAL"
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")

# Header aliases, in order of preference.
COLUMN_ALIASES = {
    "id": ("id", "identifier", "termid", "entryid", "key", "code", "uid", "guid"),
    "business_name": ("businessname", "term", "name", "businessterm", "label", "title", "attributename", "displayname", "glossaryterm"),
    "logical_name": ("logicalname", "technicalname", "physicalname", "columnname", "fieldname", "attribute", "column"),
    "definition": ("definition", "description", "businessdefinition", "meaning", "comment", "documentation", "doc", "notes", "summary"),
    "data_type": ("datatype", "type", "sqltype", "logicaltype", "format"),
    "domain": ("domain", "subjectarea", "category", "businessdomain", "topic", "table", "entity", "schema"),
    "protection_level": ("protectionlevel", "classification", "sensitivity", "governance", "governancestatus", "confidentiality", "securityclassification"),
    "governance_code": ("governancecode", "protectionclass", "protectionclasscode", "protectioncode", "classificationcode", "dataclasscode", "governanceclass"),
}

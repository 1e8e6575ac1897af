"""Redaction of personal data in texts and of sensitive keys in maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and what replaces them, in order.
PII = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN_REDACTED]"),
    (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CC_REDACTED]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
)
# Keys whose values are hidden.
SENSITIVE_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "authorization", "auth", "credential", "private_key", "ssn", "social_security", "credit_card", "card_number")


def redact_pii(text: Column) -> Column:
    for pattern, mask in PII:
        text = F.regexp_replace(text, pattern, mask)
    return text


def redact_map(values: Column) -> Column:
    """A string map with sensitive keys hidden and personal data redacted in the rest."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("[REDACTED]")).otherwise(redact_pii(v)))

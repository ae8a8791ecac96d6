"""pseudoveil: find and pseudonymise personal data in Spark DataFrames."""

from .operators.redact import Config, RedactionResult, redact_documents, redact_table, redact_units

__all__ = ["Config", "RedactionResult", "redact_documents", "redact_table", "redact_units"]

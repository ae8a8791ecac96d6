"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from . import oracle as O
from . import queries as Q

QUERIES = {
    "detect_email": Q.detect_email,
    "detect_phone": Q.detect_phone,
    "detect_ssn": Q.detect_ssn,
    "detect_ip": Q.detect_ip,
    "detect_credit_card": Q.detect_credit_card,
    "detect_dob": Q.detect_dob,
    "detect_address": Q.detect_address,
    "context_persons": Q.context_persons,
    "mobile_number": Q.mobile_number,
    "normalize_key": Q.normalize_key,
    "resolve_overlaps": Q.resolve_overlaps,
    "redact_documents": Q.redact_documents,
    "mapping_new_keys": Q.mapping_new_keys,
    "surrogate_uniqueness": Q.surrogate_uniqueness,
    "category_counts": Q.category_counts,
    "detect_address_labelled": Q.detect_address_labelled,
    "unique_persons": Q.unique_persons,
    "person_sources": Q.person_sources,
    "person_sample": Q.person_sample,
    "mapping_json_roundtrip": Q.mapping_json_roundtrip,
    "suppress_generated": Q.suppress_generated,
    "mapping_lookup": Q.mapping_lookup,
    "redact_table_cells": Q.redact_table_cells,
    "redact_second_run": Q.redact_second_run,
    "mapping_append": Q.mapping_append,
    "mapping_append_json": Q.mapping_append_json,
    "surrogate_ids": Q.surrogate_ids,
    "redact_null_ids": Q.redact_null_ids,
    "redact_conversations": Q.redact_conversations,
    "mapping_file_roundtrip": Q.mapping_file_roundtrip,
    "ner_candidate_table": Q.ner_candidate_table,
    "ner_first_mention": Q.ner_first_mention,
    "ner_person_score": Q.ner_person_score,
    "ner_organizations": Q.ner_organizations,
    "ner_totals": Q.ner_totals,
    "ner_rejection_reasons": Q.ner_rejection_reasons,
    "ner_samples": Q.ner_samples,
}

ORACLE = {
    "detect_email": O.detect_query("EMAIL"),
    "detect_phone": O.detect_query("PHONE"),
    "detect_ssn": O.detect_query("SSN"),
    "detect_ip": O.detect_query("IP_ADDRESS"),
    "detect_credit_card": O.detect_query("CREDIT_CARD"),
    "detect_dob": O.detect_query("DATE"),
    "detect_address": O.detect_query("ADDRESS"),
    "context_persons": O.detect_query("PERSON"),
    "mobile_number": O.mobile_number_sql(),
    "normalize_key": O.normalize_key_sql(),
    "resolve_overlaps": O.resolve_overlaps_sql(),
    "redact_documents": O.redact_documents_sql(),
    "mapping_new_keys": O.mapping_new_keys_sql(),
    "surrogate_uniqueness": O.surrogate_uniqueness_sql(),
    "category_counts": O.category_counts_sql(),
    "detect_address_labelled": O.detect_address_labelled_sql(),
    "unique_persons": O.unique_persons_sql(),
    "person_sources": O.person_sources_sql(),
    "person_sample": O.person_sample_sql(),
    "mapping_json_roundtrip": O.mapping_json_roundtrip_sql(),
    "suppress_generated": O.suppress_generated_sql(),
    "mapping_lookup": O.mapping_lookup_sql(),
    "redact_table_cells": O.redact_table_cells_sql(),
    "redact_second_run": O.redact_documents_sql(),
    "mapping_append": O.mapping_append_sql(),
    "mapping_append_json": O.mapping_append_sql(),
    "surrogate_ids": O.surrogate_ids_sql(),
    "redact_null_ids": O.redact_null_ids_sql(),
    "redact_conversations": O.redact_conversations_sql(),
    "mapping_file_roundtrip": O.mapping_file_roundtrip_sql(),
    "ner_candidate_table": O.ner_candidate_table_sql(),
    "ner_first_mention": O.ner_first_mention_sql(),
    "ner_person_score": O.ner_person_score_sql(),
    "ner_organizations": O.ner_organizations_sql(),
    "ner_totals": O.ner_totals_sql(),
    "ner_rejection_reasons": O.ner_rejection_reasons_sql(),
    "ner_samples": O.ner_samples_sql(),
}


def redact_documents(spark, sf_dir):
    return QUERIES["redact_documents"](spark, sf_dir)

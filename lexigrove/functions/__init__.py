"""Column functions shared by the operators."""

from lexigrove.functions.text import (
    agreement_label, collapse_space, confidence_label, doc_id_format, first_json_block, name_key, preview, python_strip, token_cap, tokens, topic_names,
)

__all__ = ["agreement_label", "collapse_space", "confidence_label", "doc_id_format", "first_json_block", "name_key", "preview", "python_strip", "token_cap", "tokens", "topic_names"]

"""Training-data operators: PII surrogates, BPE, secrets, language ID, exact
and near deduplication, decontamination, HTML extraction, token files.

Nothing outside this subpackage imports it.
"""

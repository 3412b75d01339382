"""Operators of a training-data pipeline over a corpus: chat formatting, toxicity, quality
rules, line dedup, license scans, web archives, benchmark decontamination, near-duplicate
documents, personal data and source mixing.  ``queries`` registers one query per operator.

Nothing else in the library imports this subpackage.
"""

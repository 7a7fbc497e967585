"""Training-data operators: search, filtering, decontamination, packing and language-model scoring.

Nothing outside this subpackage imports it. ``queries`` registers one query per operator.
"""

"""Operators for training-data pipelines: extraction, dedup, fingerprints, classifiers, mixing, sharding, packing.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
``opN_<name>`` queries and their oracle SQL; each operator has a module of its
own with a general interface.
"""

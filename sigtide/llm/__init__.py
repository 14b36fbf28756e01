"""Operators of a training-data pipeline: scanning, cleaning, scoring, encoding, packing, searching and archiving text.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""

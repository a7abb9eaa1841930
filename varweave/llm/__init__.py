"""Operators for training data: near duplicates, survivors, groups, packing, leakage and language labels.

Nothing else in the library imports this package.
"""

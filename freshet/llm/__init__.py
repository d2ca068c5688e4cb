"""Operators that prepare training text: sharding, decontamination, secrets, near duplicates and more.

Nothing else in the package imports this folder.
"""

"""Operators over tables: the indexed database, statistics, keyed stores, dictionaries and logs."""

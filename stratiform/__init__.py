"""Spark-native operators for bronze -> silver -> gold table building.

Every operator takes DataFrames and returns DataFrames; Catalyst plans them.
"""

__version__ = "0.1.0"

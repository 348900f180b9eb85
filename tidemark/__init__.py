"""Tidemark: a Spark-native relevance, labelling and text-preparation engine.

Every operator is a function from DataFrames and parameters to a DataFrame; the
plan is left to Catalyst and Python workers are used only where built-in
expressions cannot state the semantics.
"""

__version__ = "0.1.0"

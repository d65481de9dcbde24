"""Spark-first text analytics for an agglutinative language.

Sub-packages
------------
``functions``  column expressions (normalisation, transliteration, predicates)
``sources``    tables, dictionaries, model files
``operators``  relational operators over DataFrames (lookup, analysis, BPE, ...)
``plans``      whole queries built from the operators, with their SQL
``streaming``  the row-wise operators over unbounded input
``llm``        operators for training-data pipelines; nothing else imports it
"""

__version__ = "0.1.0"

"""Crop time-series analytics as plain ``DataFrame -> DataFrame`` functions on Spark.

The sub-packages follow the life of a table:

``sources``    readers, writers, schemas and the weather contract
``functions``  column expressions and aggregate expressions
``operators``  ordered scans, roll-ups, joins, reshapes, scenarios, rules, checks
``plans``      the three end-to-end pipelines built from the operators
"""

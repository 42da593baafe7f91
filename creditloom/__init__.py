"""Loan-portfolio analytics expressed as Spark DataFrame operators.

``functions``  column expressions (no shuffle, no state)
``operators``  DataFrame -> DataFrame analytics, fits and scoring
``sources``    table binding, CSV ingest and export, metric and model stores
``plans``      named analyses composed from the operators, and the SQL catalogue
``streaming``  notes on running the row-wise operators on a stream
"""

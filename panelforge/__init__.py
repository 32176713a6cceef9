"""Daily panel analytics as Spark DataFrame operators.

The data model is a long table of observations ``(period, respondent, type,
value)``.  Every operator takes DataFrames and returns DataFrames; nothing runs
until a sink, a model fit or a gate asks for rows.
"""

__version__ = "0.1.0"

"""Analytics on regular time series as Spark jobs.

A time series table is any DataFrame with one or more key columns that name the
series, a timestamp column and a value column.  Every operator takes and returns
DataFrames; nothing runs until the caller writes or collects the result, except
where a docstring says that a function runs a job.
"""

"""User-value analytics as plain Spark jobs.

Layout
------
``sources``    windowed scans of hourly tables, file pickers, sinks, test views
``functions``  column expressions only: nested values, scalars, prediction gates
``operators``  DataFrame -> DataFrame steps: missing data, features, sampling, metrics
``models``     Spark ML estimators for the buyer / revenue / stacking stages
``plans``      the end-to-end training and scoring chains
``streaming``  the scoring chain over arriving hourly files
``core``       exact ranks, quantiles and lookups that hold up under skew
"""

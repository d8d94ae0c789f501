"""Operations of a training-data pipeline, each on whole tables.

Nothing outside this package imports it. `entry.queries()` and `entry.oracle_sql()`
name the registered queries; every module holds one operator with its own,
general interface.
"""

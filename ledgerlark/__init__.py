"""ledgerlark - business analytics over Spark tables.

Every public function takes and returns Spark DataFrames.  ``functions`` holds
column expressions and the few helpers that make global orderings and exact
quantiles work on data that does not fit one task, ``operators`` the analytics
themselves, ``sources`` the readers and sinks, ``streaming`` the continuous
versions and ``plans`` the named queries over the benchmark tables.
"""

"""docweave: review-data processing on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame; ordering is always explicit, so results do not depend on
partitioning.  Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame operators), ``sources`` (readers
and writers), ``plans`` (rule compiler and registered queries), ``streaming`` (Structured Streaming wrappers).
"""

__version__ = "0.1.0"

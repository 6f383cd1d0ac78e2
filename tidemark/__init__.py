"""tidemark: sequenced, partitioned event logs as Spark DataFrames."""

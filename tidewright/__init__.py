"""A relational query engine on Spark DataFrames: builder, compiler, incremental views."""

"""codelode: analytics over source-code and documentation corpora, as Spark DataFrames."""

"""spanloom: documents, spans, tokens and labels as Spark DataFrames."""

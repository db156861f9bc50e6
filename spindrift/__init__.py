"""Analytics over captured web artefacts, expressed as Spark DataFrames."""

"""Rule-driven alerting over event data, and training-data operators, on Spark DataFrames."""

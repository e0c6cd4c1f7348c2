"""De-identification and data-processing operators built on Spark DataFrames."""

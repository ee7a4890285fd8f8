"""driftlog: keyed, ordered, log-derived state on Spark DataFrames."""

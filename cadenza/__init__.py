"""Analytics of sensor series recorded on repeated circuits, as Spark DataFrames."""

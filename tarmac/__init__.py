"""Road-network analytics on Spark: rasters, polylines, road graphs and traces as DataFrames."""

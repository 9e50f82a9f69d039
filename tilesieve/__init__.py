"""tilesieve: filtering of vector tiles and feature tables on Spark DataFrames."""

"""A web-crawl analytics engine on Spark DataFrames."""

"""tidemill: discovery analytics and corpus curation on Spark DataFrames."""

"""mediaframe: collections of media files as Spark DataFrames."""

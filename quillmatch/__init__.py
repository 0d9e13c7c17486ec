"""quillmatch: product matching, text features and data profiling on Spark DataFrames."""

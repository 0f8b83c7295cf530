"""blkscope: storage-trace analytics in PySpark DataFrames."""

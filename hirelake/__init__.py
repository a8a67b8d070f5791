"""Job-posting analytics on Spark: landing files to postings, merging, filters, statistics."""

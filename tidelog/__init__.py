"""A columnar event log on Spark: topics of partitions, appended to and read by offset, time and cursor."""

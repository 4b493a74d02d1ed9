"""Training-data pipeline operators, each a Spark job over a whole table."""

"""Event intelligence on Spark: DataFrame operators for short documents, events and their evidence."""

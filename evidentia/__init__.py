"""Evidence screening and corpus preparation as Spark DataFrame transformations."""

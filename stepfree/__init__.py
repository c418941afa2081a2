"""Step-free routing and accessibility analytics on Apache Spark."""

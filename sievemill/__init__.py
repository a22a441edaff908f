"""sievemill: corpus screening, deduplication, retrieval and evaluation on Spark."""

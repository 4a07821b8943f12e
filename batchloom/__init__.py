"""batchloom: product-analytics event batches on Spark."""

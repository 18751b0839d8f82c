"""Analytics for wearable-sensor recordings on Spark."""

"""Graph and table analytics on Spark."""

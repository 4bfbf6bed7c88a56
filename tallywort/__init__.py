"""Evidence reconciliation and training-data preparation on Spark."""

"""framegate: capture-quality analytics and training-data preparation on Spark."""

"""Memory analytics on Spark: operators over tables and streams of conversational memory."""

"""tidemark: event, market-series, text and graph analytics expressed as Spark DataFrame jobs."""

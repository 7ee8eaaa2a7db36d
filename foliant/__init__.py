"""Analytics over digitised document corpora, as Spark DataFrame jobs."""

"""Analytics over media evidence, expressed as Spark DataFrame plans."""

"""Analytics over event logs and experiments, written as Spark DataFrame operators."""

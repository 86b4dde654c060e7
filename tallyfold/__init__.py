"""Analytics over catalogues of single-cell datasets, as Spark DataFrame operators."""

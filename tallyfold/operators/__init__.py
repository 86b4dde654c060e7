"""DataFrame operators. None of them hints a broadcast: Spark picks one from table sizes."""

"""Trial-based time-series analytics on Spark: features, windows, many small models, grouped AUCs, transfer, tests."""

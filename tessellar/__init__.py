"""A PySpark-native engine for labelled time series, with PromQL as its query language."""

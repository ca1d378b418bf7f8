"""lakeloom: a Spark-native engine for versioned, tagged collections of records.

See the README for the map of modules.
"""

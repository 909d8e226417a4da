"""biblioforge: a Spark-native engine for building and analysing literature inventories."""

"""PySpark-native engine for span-annotated datasets: preparation, retrieval and evaluation."""

"""A Spark-native engine for knowledge graphs, retrieval and document pipelines."""

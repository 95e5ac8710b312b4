"""A Spark-native engine for captured pages, documents and texts: identity, gates, versions, evidence, search and reports."""

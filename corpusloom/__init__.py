"""corpusloom: a PySpark-native engine for document and knowledge corpora."""

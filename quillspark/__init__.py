"""quillspark: a Spark-native document analytics engine."""

"""knapline: Spark-native analytics over collections of scanned 3D objects and their embeddings."""

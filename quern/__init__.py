"""quern: retrieval, corpus and operations analytics as PySpark DataFrame programs."""

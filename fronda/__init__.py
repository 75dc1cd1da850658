"""A PySpark engine for component graphs and training corpora."""

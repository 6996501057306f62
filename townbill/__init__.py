"""Town-listing catalogue and engagement analytics as PySpark table operators."""

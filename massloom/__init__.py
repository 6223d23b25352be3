"""A Spark-first analytics engine for mass-spectrometry tables."""

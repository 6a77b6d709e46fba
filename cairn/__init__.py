"""Document-accessibility analytics on Spark: one relational kernel over flat document tables."""

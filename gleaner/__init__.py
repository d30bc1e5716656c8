"""Spark-first engine for business-contact data: landed snapshots in, one clean lead table out."""

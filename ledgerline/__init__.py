"""Provenance analytics for governed document corpora, as Spark DataFrame operators."""

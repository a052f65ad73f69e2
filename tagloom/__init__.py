"""Curation of captioned record collections as Spark DataFrame operators."""

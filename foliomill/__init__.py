"""Spark jobs over large collections of documents and web pages."""

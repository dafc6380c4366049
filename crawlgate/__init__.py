"""Crawl-policy analytics on Spark."""

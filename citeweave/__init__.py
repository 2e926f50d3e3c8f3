"""Quotation checking and corpus preparation on Spark."""

"""Lossless record analytics on Spark."""

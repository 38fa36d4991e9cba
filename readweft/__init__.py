"""Sequencing reads as Spark DataFrames: scans, sinks, filters, searches, samples and reports."""

__version__ = "0.2.0"

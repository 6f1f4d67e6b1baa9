"""Inputs and outputs: file scans, corpus views, the Parquet table store, text sinks."""

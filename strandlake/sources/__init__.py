"""Readers and writers: files to DataFrames of fixed schemas, and back."""

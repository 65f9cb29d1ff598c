"""Quillspark: letters, notices and training text as Spark DataFrames."""

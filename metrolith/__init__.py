"""Metrolith: measures collections of code fragments and texts as Spark DataFrames."""

"""Gleaner: a secret-scanning and corpus engine built on Spark DataFrames."""

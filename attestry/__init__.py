"""Licence-evidence analytics over whole fleets of source trees, on Spark DataFrames."""

"""Labelled raster observations as Spark DataFrames.

``functions`` holds column expressions, ``operators`` holds DataFrame -> DataFrame
transformations, ``sources`` holds scans and sinks, ``plans`` wires them into the
registered queries.
"""

__version__ = "0.1.0"

"""strataloom: a Spark-native engine over repository catalogues.

Record families (artifacts, nodes, edges, evidence, documents ...) are plain
DataFrames; every operator is a function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"

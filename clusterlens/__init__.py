"""clusterlens: Spark-native clustering analytics on catalogue-style tables.

Row-level work is expressed as DataFrame / SQL operators that run on the
executors; only model-sized results (k x d parameters, d x d moments,
vocabularies, candidate grids, bounded samples) reach the driver.
"""

__version__ = "0.1.0"

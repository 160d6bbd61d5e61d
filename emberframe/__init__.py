"""emberframe: Spark-native operators for daily wildfire-spread analytics."""

__version__ = "0.1.0"

"""flowgrid: a PySpark-native engine for ordered event and network-flow analytics."""

__version__ = "0.1.0"

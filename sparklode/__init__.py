"""sparklode: a PySpark-native engine for code-intelligence analytics and training-data preparation."""

__version__ = "0.1.0"

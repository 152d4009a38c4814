"""skein: a PySpark-native engine for coding-agent session analytics and corpus preparation."""

__version__ = "0.1.0"

"""Tessera: a PySpark-native relational engine and training-data toolkit."""

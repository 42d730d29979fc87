"""PySpark-native analytics for trade documents: matching, classification, reconciliation, apportionment and history."""

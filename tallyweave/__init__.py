"""tallyweave: a PySpark-native analytics engine for transaction ledgers."""

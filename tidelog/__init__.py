"""tidelog: a PySpark-native engine for append-only event logs whose state is derived by declared rules."""

"""PySpark-native analytics over people, provider details, appointments and messages."""

"""PySpark-native artifact similarity analytics."""

"""sparkloom: a PySpark-native analytics engine for requirement-style text and decision data."""

"""wardstone: a Spark-native engine for screening untrusted text and measuring the screen."""

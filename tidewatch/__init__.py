"""tidewatch: a Spark-native engine for labelled network-event analytics."""

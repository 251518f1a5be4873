"""kinsieve: Spark-native operators that audit how datasets overlap."""

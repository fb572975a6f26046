"""capsite: PySpark-native analytics for transcription-start-site (5'-end) sequencing signal."""

"""Build, clean, balance and check labelled corpora of short social posts with Spark."""

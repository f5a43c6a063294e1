"""plumbline: judge detectors and their confidence scores with Spark jobs."""

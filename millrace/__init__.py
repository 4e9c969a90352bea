"""Feature engineering, models, metrics and run bookkeeping as Spark jobs."""

__version__ = "0.1.0"

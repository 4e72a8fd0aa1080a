"""rolecall: job-posting and resume analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"

"""plumbline: integrity assurance for data pipelines, declared as Spark DataFrame plans."""

__version__ = "0.1.0"

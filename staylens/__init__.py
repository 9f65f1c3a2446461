"""staylens: admissions / length-of-stay analytics as Spark DataFrame plans."""

__version__ = "0.1.0"

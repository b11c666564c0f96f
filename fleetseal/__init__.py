"""File and registry integrity analytics for a fleet of hosts, on PySpark."""

__version__ = "0.1.0"

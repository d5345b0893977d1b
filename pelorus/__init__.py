"""Pelorus: maritime route analytics and corpus operators on PySpark."""

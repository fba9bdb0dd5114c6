"""Music-catalogue analytics as DataFrame-to-DataFrame operators on PySpark."""

"""Spark-native analytics over keyed object catalogues and their operation logs."""

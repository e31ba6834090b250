"""Text-template corpus analytics as Spark plans."""

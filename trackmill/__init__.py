"""Track, annotation and corpus analytics expressed as Spark plans."""

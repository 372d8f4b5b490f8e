"""Narrative recurrence analytics on Spark: sightings, blocked similarity lookup, clusters, and corpus operators."""

"""Claim verification analytics on Spark: text corpus -> claims -> official evidence -> verdict tables."""

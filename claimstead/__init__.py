"""Claim-evidence analytics over whole corpora, as Spark DataFrame transformations."""

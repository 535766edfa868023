"""Tidewater: a strictly typed relational query language with live results, on PySpark."""

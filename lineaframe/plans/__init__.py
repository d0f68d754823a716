"""The plan language: types, expressions, steps, validation, JSON, hashing and sentences. Pure Python, no Spark."""

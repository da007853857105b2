"""Streaming.

The recommender is batch-only: it has no watermark, window, stateful or
late-data semantics, so nothing is built here. Every operator in this package
is a plain DataFrame transformation, so a caller can apply it per micro-batch
inside ``writeStream.foreachBatch`` without extra code.
"""

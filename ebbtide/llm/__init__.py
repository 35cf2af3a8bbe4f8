"""Operators of a large-scale training-data pipeline.

Every module holds one operator with its own general interface; ``queries.py``
applies them to the test tables with production parameters. Nothing outside
this folder (but the registry entry point) imports it.
"""

"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus the names of its identifier and text columns and selects only
those, so extra columns (also with clashing names) never matter.
"""

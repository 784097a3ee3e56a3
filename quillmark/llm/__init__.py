"""Operators for large training corpora.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries, one per operator; each operator's module documents what it
does with nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns.
"""

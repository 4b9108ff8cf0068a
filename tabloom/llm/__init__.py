"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage; its queries are in
:mod:`tabloom.llm.queries` and are added to the driver's list only when the
subpackage can be imported.
"""

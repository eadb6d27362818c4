"""Training-data operators: filters, near-duplicate search, formatting, mixing and output.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the thin
``opN_<name>`` queries; every operator lives in a module of its own with a general
interface and is imported from there.
"""

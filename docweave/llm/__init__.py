"""Operators for preparing training data.  Nothing else in docweave imports this subpackage."""

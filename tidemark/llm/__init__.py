"""Operators for preparing training text: quality, toxicity, archives, URL
filters, sanitisation, decontamination, packing, language and near duplicates.

Nothing else in the library imports this subpackage."""

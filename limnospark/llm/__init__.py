"""Operators for preparing training data: extraction, fingerprints,
de-duplication, classifiers, mixing, sharding, nearest neighbours, encoding.

Nothing outside this subpackage imports it; ``queries`` registers one query
``opN_<name>`` per operator."""

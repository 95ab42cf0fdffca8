"""Training-data operators: archives, token counts, scans, language ID, deduplication, decontamination.

Nothing outside this subpackage imports it. ``queries.QUERIES`` and ``queries.ORACLES`` hold the registered
queries; ``__spark_entry__`` adds them when the subpackage is there.
"""

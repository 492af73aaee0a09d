"""Training-data operators: PII, language model scoring, quality, secrets, near-dedup,
token output, nearest neighbours, mixing, decontamination and language ID.

Nothing else in the package imports this subpackage.  Executors import it by name, so ship
the package with ``--py-files`` (or install it) on a cluster.
"""

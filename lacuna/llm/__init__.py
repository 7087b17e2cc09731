"""Training-data operations: token files, BPE, near-duplicates, fingerprints, decontamination, extraction, WARC, scans and classifiers.

Nothing outside this subpackage imports it.
"""

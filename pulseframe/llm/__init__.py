"""Operators for training corpora: deduplication, fingerprints, shards, quality, tokens, personal data, licences, mixing."""

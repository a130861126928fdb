"""Readers and writers of records, raw corpora, manifests and request streams."""

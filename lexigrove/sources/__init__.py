"""Readers and writers of corpora, datasets, agent outputs and run artefacts."""

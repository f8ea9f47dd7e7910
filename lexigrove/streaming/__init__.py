"""Streams of agent outputs."""

"""Operators over tables of artefacts and observations."""

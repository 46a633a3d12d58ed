"""Whole builds and searches, composed of operators."""

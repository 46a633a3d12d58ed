"""Relational operators over declared tables; every one takes many documents or queries at a time."""

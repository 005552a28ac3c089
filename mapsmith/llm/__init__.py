"""Operators for preparing large text corpora; nothing else in mapsmith imports this subpackage."""

"""Tests of the matrix operators; the session fixture is in tests/conftest.py."""

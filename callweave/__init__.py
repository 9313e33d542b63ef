"""Telecom-signalling analytics as DataFrame -> DataFrame operators."""

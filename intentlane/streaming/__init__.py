"""Structured Streaming jobs: INT-5 intent detection, GOV-3 gate, RTY routing."""

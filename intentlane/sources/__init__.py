"""Sources and sinks (SRC-*, SNK-*) and the fixture views over the driver's tables."""

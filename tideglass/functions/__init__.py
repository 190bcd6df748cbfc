"""Part of the telemetry engine; see README.md."""

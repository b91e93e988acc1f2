"""Scans, sinks, manifests, fingerprints and packed exports."""

"""Scans, payload probes, paging rules, catalog upkeep and result sinks."""

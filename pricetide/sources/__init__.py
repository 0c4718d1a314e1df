"""Scans and sinks: dictionaries, pastes, recogniser output, responses, records, exports."""

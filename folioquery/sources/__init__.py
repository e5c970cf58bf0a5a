"""Sources and sinks: company files, filing and transcript listings, statements, caches."""

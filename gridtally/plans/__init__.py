"""Jobs composed of operators: ingest, quality suite, pipeline, and the registered queries."""

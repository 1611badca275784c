"""DataFrame operators: ingest, access, retrieval, guards, answers, audit."""

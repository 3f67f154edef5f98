"""Sources and sinks: element and chunk JSON, PDF files, HTML tables, the vector store, append logs, objects."""

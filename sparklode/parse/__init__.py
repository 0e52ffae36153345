"""Source files to symbols, imports, calls and routes: one light parser driven by a table of languages."""

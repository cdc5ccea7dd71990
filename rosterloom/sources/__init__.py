"""Sources: recognised text (TSV), documents on file, positioned words, and upload checks."""

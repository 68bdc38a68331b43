"""Tables in (rows, columns, files, generators) and results out."""

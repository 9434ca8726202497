"""Column expressions over boxes, lines, polygons, vectors and labels."""

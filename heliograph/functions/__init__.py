"""Column builders: vectors, seeded uniforms, names, times and small parsers."""

"""Column functions: deterministic uniforms, fingerprints, formats and policies."""

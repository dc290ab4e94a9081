"""Column functions: identities, keys, paths, codecs."""

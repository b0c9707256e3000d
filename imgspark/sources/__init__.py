"""Image files in, pictures and bundles out, and tables derived for tests."""

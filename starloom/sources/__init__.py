"""starloom.sources"""

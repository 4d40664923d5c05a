"""starloom.plans"""

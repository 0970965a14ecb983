"""Training-data operators: thirteen operators over documents, pages, conversations and clicks.

Nothing else in the library imports this subpackage.
"""

"""Training-data operators.

The package stands alone: nothing else in the library imports it, and it
imports nothing from the rest of the library.
"""

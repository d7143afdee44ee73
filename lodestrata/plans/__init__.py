"""Registered queries. Importing the package registers all of them."""

from . import ingest, itineraries, routing, rules, search, serving, streams, trips  # noqa: F401

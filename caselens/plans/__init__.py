"""Registered queries: each module wires operators to the driver tables."""

from importlib import import_module

MODULES = ["pages", "retrieval", "scoring", "periods", "safety", "evidence", "extraction", "suites"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"caselens.plans.{name}")

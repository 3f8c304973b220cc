"""Runnable queries over the driver's tables, by area."""

import importlib

AREAS = ("lines", "intervals", "frames", "evaluation", "cleaning", "alignment", "jobs", "streaming")


def load():
    for area in AREAS:
        importlib.import_module(f"cuesheet.catalog.{area}")
    return importlib.import_module("cuesheet.catalog.registry")

"""Converter plug-ins: one module each, found by ``featurekit.plans.convert.discover``."""

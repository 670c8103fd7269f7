"""Estimators with `fit`, returning immutable models with `transform`."""

"""Coded-corpus analytics as Spark DataFrame operators."""

from weftline.project import Project

__all__ = ["Project"]

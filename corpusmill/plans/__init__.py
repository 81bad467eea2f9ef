"""Registered queries: each composes operators over the tables and, where SQL can say it, carries its SQL twin."""

from ..registry import Registry

REGISTRY = Registry()

from . import cleaning, corpus, evaluation, retrieval, sessions, tasks, web  # noqa: E402, F401

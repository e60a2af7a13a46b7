"""Registered queries over the fixture tables; importing this package registers all of them."""

from . import registry  # noqa: I001
from . import relational, texts, studies, evaluation, decisions, statistics, files, streams

__all__ = ["decisions", "evaluation", "files", "registry", "relational", "statistics", "streams", "studies", "texts"]

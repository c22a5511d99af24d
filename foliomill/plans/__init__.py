"""Queries over the given tables; importing the package registers all of them."""

from . import placing, publishing, reading, rebuilding, registry, trees  # noqa: F401

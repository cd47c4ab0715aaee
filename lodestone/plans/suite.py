"""All query modules; importing this registers them."""

from . import analytics, applied, features, modelling, relational, serving  # noqa: F401

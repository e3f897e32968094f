from .sql import ORACLES  # noqa: F401

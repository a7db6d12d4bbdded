"""Errors by what they are about; all of them are EngineErrors (M5)."""


class EngineError(Exception):
    pass


class ScenarioError(EngineError, ValueError):
    """A scenario file of an unknown format or without what a scenario needs."""


class LearningError(EngineError, ValueError):
    """A store that cannot be read."""


class PackError(EngineError, ValueError):
    """A pack file of an unknown format, or one that holds no mapping."""


class PreprocessError(EngineError, RuntimeError):
    """No compiler, or an unknown architecture."""


class ConcurrentChangeError(EngineError, RuntimeError):
    """Another change of a table came first; read it again and repeat the change."""

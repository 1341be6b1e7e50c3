"""axiomill: rule materialisation and data processing over triples, on Spark DataFrames."""

__version__ = "0.1.0"
__all__ = ["Options", "Reasoner", "__version__"]


def __getattr__(name: str):
    if name in ("Options", "Reasoner"):
        from axiomill import session

        return getattr(session, name)
    raise AttributeError(name)

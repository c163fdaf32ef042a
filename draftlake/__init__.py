"""Collection-scale analysis of 2-D technical drawings on Spark.

``analyse_files(spark, path)`` runs all passes over the drawings of a path or glob; ``analyse_file(path)`` returns one
drawing's results as a dictionary and its report as Markdown.
"""

from importlib import import_module

#: Where the public names are; they are imported when they are asked for, so that Python workers load what they need only.
_HOME = {
    "Analysis": ("plans.analysis", "Analysis"), "analyse": ("plans.analysis", "analyse"),
    "analyse_files": ("plans.analysis", "analyse_path"),
    "analyse_file": ("plans.documents", "analyse_file"), "write_documents": ("plans.documents", "write_documents"),
    "read_dxf": ("sources.dxf", "read_dxf"),
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, attribute = _HOME[name]
    return getattr(import_module(f".{module}", __name__), attribute)

"""specweave: requirement-traceability analytics on PySpark.

The names below are loaded when first used, so that workers that need one
module don't import the others.
"""

from importlib import import_module

__version__ = "0.1.0"

_PUBLIC = {
    "Trace": "plans.analysis", "tag_filter": "plans.analysis", "Report": "report", "files_frame": "operators.extract", "parsed": "operators.extract", "trace_of": "operators.extract",
    "ReadError": "operators.extract", "collect_files": "sources.tree", "parse_code": "operators.code_scan", "parse_markdown": "operators.markdown_scan",
}
__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_PUBLIC[name]}", __name__), name)

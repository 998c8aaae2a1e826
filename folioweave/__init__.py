"""Linking, grouping and auditing of ordered document captures on Spark."""

_API = ("LinkConfig", "cluster", "cluster_directory", "cluster_files", "cluster_images", "crop_directory", "crop_groups", "crop_result", "rank_candidates", "read_result", "write_result")


def __getattr__(name: str):
    """The entry points of ``api``, imported when they are asked for, as executors need none of them."""
    if name in _API:
        from . import api

        return getattr(api, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__() -> list[str]:
    return sorted([*globals(), *_API])

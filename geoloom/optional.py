"""Optional packages: import them where they are needed, and say which extra holds them."""

from __future__ import annotations

import importlib
import logging

log = logging.getLogger(__name__)


def optional_import(group: str, *modules: str, missing: str = "raise"):
    """The modules, or None for each that is absent when ``missing`` is "warn" or "ignore"."""
    if missing not in ("raise", "warn", "ignore"):
        raise ValueError("missing must be raise, warn or ignore")
    out = []
    for m in modules:
        try:
            out.append(importlib.import_module(m))
        except ImportError as error:
            if missing == "raise":
                raise ImportError(f"{m} is needed; it belongs to the optional group {group}") from error
            if missing == "warn":
                log.warning("%s (group %s) is absent", m, group)
            out.append(None)
    return out[0] if len(out) == 1 else tuple(out)

"""Failure texts: local paths redacted, causes told apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a missing device in a provider's failure text, lower case.
NO_DEVICE = (
    "887a0002", "887a0004", "c0262002", "dxgi_error_not_found", "dxgi_error_unsupported", "error_graphics_invalid_display_adapter",
    "no compatible directx 12 device", "no available directx 12 device", "no gpus or npus detected",
)
#: A quote, comma, semicolon or line end closes a path; white space only one that is not on a drive.
_END = r"""\r\n"',;"""
_SEGMENTS = r"(?:[^/\s:]+/)+"
#: How a local path begins, and how far it then reaches.
_KINDS = {r"[a-z]:[\\/]": f"[^{_END}]*", r"\\\\|//": rf"[^\s{_END}]+", f"/{_SEGMENTS}": rf"[^\s{_END}]*"}
_CODE_FILE = rf"(?:{'|'.join([*list(_KINDS)[:2], '/'])})[^{_END}]*?\.(?:cc?|cpp|h(?:pp)?)"
_LINE = r"\(\d+\)|:\d+:"
#: A code file up to its line, which stays as the group, or any other path.
_LOCAL = "(?i)" + "|".join([f"{_CODE_FILE}({_LINE})", *[f"(?:{begin}){rest}" for begin, rest in _KINDS.items()]])
_META = re.compile(r"[^\w\s]")


def _folder(path: str) -> str:
    """A pattern of the folder, whichever way its slashes lean."""
    return r"[\\/]".join(_META.sub(lambda m: "\\" + m[0], part) for part in re.split(r"[\\/]", path))


def redact(reason: Column, folders: list[str] = ()) -> Column:
    """Known folders by name, then any local path in one pass, keeping the line of a code file."""
    known = [_folder(f) for f in sorted(set(folders), key=len, reverse=True) if f]
    named = F.regexp_replace(reason, "|".join(known), "<model-directory>") if known else reason
    return F.regexp_replace(named, _LOCAL, "<local-path>$1")


def failure_class(reason: Column) -> Column:
    low = F.lower(reason)
    missing = F.lit(False)
    for marker in NO_DEVICE:
        missing = missing | F.contains(low, F.lit(marker))
    return (F.when(F.startswith(reason, F.lit("directml-dll-missing:")), reason)
            .when(missing, F.concat(F.lit("directml-no-device: "), reason)).otherwise(F.concat(F.lit("directml-init-failed: "), reason)))

"""Settings from a file of ``NAME=value`` lines."""

from __future__ import annotations

import os
from pathlib import Path


def parse_settings(text: str) -> dict[str, str]:
    """Names and values; comments and lines without "=" are passed over, one pair of quotes around a value goes."""
    found = {}
    for line in text.splitlines():
        if line.lstrip().startswith("#") or "=" not in line:
            continue
        name, given = (part.strip() for part in line.split("=", 1))
        if len(given) > 1 and given[0] == given[-1] and given[0] in ("'", '"'):
            given = given[1:-1]
        if name:
            found[name] = found.get(name) or given
    return found


def load_settings(path: str | Path) -> dict[str, str]:
    """Set the variables of the file that are not set or empty; the ones that were set."""
    given = parse_settings(Path(path).read_text("utf-8")) if Path(path).is_file() else {}
    done = {name: value for name, value in given.items() if not os.environ.get(name)}
    os.environ.update(done)
    return done

"""What a Python worker remembers between tasks: the stores of one operator at a time.

Spark uses workers again for later stages. Without this, what one operator keeps there would stay beside
what the next ones keep.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable
from typing import Any

_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """The worker's store of this name, made if need be; all other stores go first."""
    if name not in _HELD:
        _HELD.clear()
        with contextlib.suppress(AttributeError, OSError):  # other systems' C libraries have no such function
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[name] = make()
    return _HELD[name]

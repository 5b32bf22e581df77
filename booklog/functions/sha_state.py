"""A SHA-256 that can stop and go on in another task.

The library's structure for it is plain memory, so its bytes are the state. ``hashlib`` gives no
way to its state, and the built-in function wants the whole value.
"""

import ctypes
import ctypes.util
from functools import lru_cache

_STATE_BYTES = 112


@lru_cache
def _library() -> ctypes.CDLL:
    return ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")


def is_available() -> bool:
    try:
        return hasattr(_library(), "SHA256_Update")
    except OSError:
        return False


def begin() -> bytes:
    state = ctypes.create_string_buffer(_STATE_BYTES)
    _library().SHA256_Init(state)
    return state.raw


def update(state: bytes, content: bytes) -> bytes:
    held = ctypes.create_string_buffer(state, _STATE_BYTES)
    _library().SHA256_Update(held, content, ctypes.c_size_t(len(content)))
    return held.raw


def digest(state: bytes) -> str:
    held, out = ctypes.create_string_buffer(state, _STATE_BYTES), ctypes.create_string_buffer(32)
    _library().SHA256_Final(out, held)
    return out.raw.hex()

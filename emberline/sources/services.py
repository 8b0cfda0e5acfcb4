"""Map and geocoding services behind one interface, with caches; nothing here is called by executors."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from pathlib import Path


class Cached:
    """Answers by key from a file; misses are asked of ``fetch`` up to ``tries`` times, ``pause`` seconds apart. Empty answers are kept too."""

    def __init__(self, path: str, fetch: Callable[[str], object] | None = None, pause: float = 0.0, tries: int = 3):
        self.path, self.fetch, self.pause, self.tries = Path(path), fetch, pause, tries
        self.known = json.loads(self.path.read_text()) if self.path.exists() else {}
        self.lock, self.last = threading.Lock(), 0.0

    def get(self, key: str):
        with self.lock:
            if key in self.known or self.fetch is None:
                return self.known.get(key)
            for i in range(self.tries):
                time.sleep(max(0.0, self.last + self.pause - time.monotonic()))
                self.last = time.monotonic()
                try:
                    self.known[key] = self.fetch(key)
                    break
                except OSError:
                    if i == self.tries - 1:
                        return None
            self.path.write_text(json.dumps(self.known))
            return self.known[key]


def map_features(path: str, fetch: Callable[[str], object] | None = None) -> Cached:
    """Features by box ``south,west,north,east``."""
    return Cached(path, fetch, tries=3)


def geocoder(path: str, fetch: Callable[[str], object] | None = None) -> Cached:
    """Coordinates by name; calls are at least 1.05 seconds apart."""
    return Cached(path, fetch, pause=1.05, tries=1)

"""Document and collection paths, document ids, and path patterns."""

from __future__ import annotations

import re
import secrets
import string as _string

_ALPHABET = _string.ascii_letters + _string.digits


class PathError(ValueError):
    pass


def segments(path: str) -> list[str]:
    found = path.split("/")
    if not path or "" in found:
        raise PathError(f"empty segment in path {path!r}")
    return found


def is_document(path: str) -> bool:
    return bool(path) and "" not in path.split("/") and path.count("/") % 2 == 1


def is_collection(path: str) -> bool:
    return bool(path) and "" not in path.split("/") and path.count("/") % 2 == 0


def split_document(path: str) -> tuple[str, str, str]:
    """(collection path, collection id, document id) of a document path."""
    if not is_document(path):
        raise PathError(f"not a document path: {path!r}")
    collection, _, doc = path.rpartition("/")
    return collection, collection.rpartition("/")[2], doc


def new_id() -> str:
    """20 random letters and digits."""
    return "".join(secrets.choice(_ALPHABET) for _ in range(20))


class Pattern:
    """``users/{id}/posts/{rest=**}``: literals, one-segment captures, and a last capture of all that follows."""

    _CAPTURE = re.compile(r"\{([A-Za-z_]\w*)(=\*\*)?\}$")

    def __init__(self, text: str):
        self.text, parts = text, segments(text)
        self.parts: list[tuple[str, str]] = []
        for i, p in enumerate(parts):
            m = self._CAPTURE.match(p)
            if m and m[2] and i < len(parts) - 1:
                raise PathError(f"{p} must come last in {text!r}")
            if not m and re.search(r"[*{}]", p):
                raise PathError(f"bad segment {p!r} in {text!r}")
            self.parts.append(("rest" if m and m[2] else "one" if m else "literal", m[1] if m else p))

    def match(self, path: str) -> dict[str, str] | None:
        """Captures if the path fits, else None; a last capture takes one segment or more."""
        found, out = path.split("/"), {}
        for i, (kind, name) in enumerate(self.parts):
            if i >= len(found):
                return None
            if kind == "rest":
                return out | {name: "/".join(found[i:])}
            if kind == "one":
                out[name] = found[i]
            elif found[i] != name:
                return None
        return out if len(found) == len(self.parts) else None

    def regex(self) -> str:
        """A regular expression for the paths that fit."""
        return "^" + "/".join({"literal": re.escape(name), "one": "[^/]+", "rest": ".+"}[kind] for kind, name in self.parts) + "$"
